"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of bytes that occurs inside no vocabulary token can lie inside no merge result,
so a token ends between the two whatever the merges do. Texts are cut at such pairs,
the fragments are encoded independently, and their ids are concatenated; that equals
encoding the text whole.

Cuts are made twice. A space after any other letter is such a pair in a byte-level
vocabulary (the constructor makes sure), and never inside a word of the pre-tokenizer,
whose rules look only at white space ahead; so a text first falls into fragments at
spaces, which repeat and are looked up. A fragment that is new is split into words, each
word is cut at all forced pairs of its bytes, and those parts are merged.

The vocabulary file is read by the driver and broadcast; its size is checked against
``VOCAB_BYTES`` first. Caches of encoded words are bounded.

Cases. Null text counts as empty: no ids, empty decoded text. The strings of added
tokens found in a text become their ids, as in the tokenizers library by default. Texts
of any length are encoded whole. Null ids of rows and extra columns pass through; a
repeated row gets a row each time; empty tables give empty results. Ids outside the
vocabulary decode to nothing; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The largest vocabulary file that is broadcast.
VOCAB_BYTES = 64 << 20
#: Entries that a cache takes (words that come often come early), and the longest key that is kept.
CACHE_WORDS, CACHE_LETTERS = 180_000, 64
#: Parts up to this length are merged together, longer ones one by one by a heap; rows merged at once.
SHORT, ROWS = 40, 20_000
NONE = (1 << 31) - 1
#: Ids decoded at once.
STEP = 1 << 18
#: Text bytes of an output batch.
BATCH_BYTES = 2 << 20

# The split of byte-level BPE into words, with Unicode white space spelt out.
SPACE = r"\t-\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter to byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Tokens as bytes by id, merges by rank, and added tokens, of a byte-level BPE file."""
    if (size := os.path.getsize(path)) > VOCAB_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {VOCAB_BYTES} are broadcast")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = (spec.get("pre_tokenizer") or {}).get("type")
    if spec["model"]["type"] != "BPE" or kind != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
    letters = byte_letters()
    plain = lambda token: bytes(letters[c] for c in token)
    ids = spec["model"]["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    return {
        "tokens": {i: plain(t) for t, i in ids.items()},
        "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges],
        "added": {x["content"]: x["id"] for x in spec.get("added_tokens", [])},
    }


def public_vocabulary() -> str:
    """The path of the public byte-level vocabulary of 50k tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ForcedBoundaryBPE:
    """Encodes and decodes whole texts; see the module's description."""

    def __init__(self, vocabulary: dict):
        tokens, self.added = vocabulary["tokens"], vocabulary["added"]
        self.single = {t[0]: i for i, t in tokens.items() if len(t) == 1}
        self.ranks = {(a, b): (rank, to) for rank, (a, b, to) in enumerate(vocabulary["merges"])}
        self.single_ids = np.full(256, -1, np.int64)
        self.single_ids[list(self.single)] = list(self.single.values())
        pairs = np.array([(a << 32 | b) for a, b, _ in vocabulary["merges"]], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pair_keys, self.pair_rank = pairs[order], order
        self.merged = np.array([to for _, _, to in vocabulary["merges"]], np.int64)
        # pairs of bytes that lie inside some token
        self.inside = np.zeros(1 << 16, bool)
        for t in tokens.values():
            raw = np.frombuffer(t, np.uint8).astype(np.int64)
            self.inside[raw[:-1] << 8 | raw[1:]] = True
        pieces = tokens | {i: t.encode() for t, i in self.added.items()}
        listed = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.sizes = np.array([len(x) for x in listed])
        self.starts, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(listed), np.uint8)
        # a space follows only white space inside tokens: then it is a forced boundary after any other letter
        self.spaced = all(t.decode("utf-8", "replace").isspace() for t in tokens.values() if b" " in t[1:])
        self.pattern = regex.compile(WORDS)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self.words: dict[str, bytes] = {}
        self.fragments: dict[str, bytes] = {}

    def _merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one part: always the merge of lowest rank, leftmost first."""
        ids, ranks = [self.single[b] for b in raw], self.ranks
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], k, ids[k], ids[k + 1], r[1]) for k in range(n - 1) if (r := ranks.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, to = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j] = to, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if r := ranks.get((to, ids[after[k]])):
                    heapq.heappush(heap, (r[0], k, to, ids[after[k]], r[1]))
            if (i := before[k]) >= 0 and (r := ranks.get((ids[i], to))):
                heapq.heappush(heap, (r[0], i, ids[i], to, r[1]))
        return tuple(x for x in ids if x >= 0)

    # ---- many words at once ----

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none (ids below 0 are gaps)."""
        keys = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_rank[at], NONE).astype(np.int32)

    def _merge_all(self, ids: np.ndarray) -> np.ndarray:
        """Rows of ids, gaps of -1 at the end, each merged as far as it goes."""
        done, rows = ids.copy(), np.arange(len(ids))
        ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
        place = np.arange(ids.shape[1])
        while len(rows):
            k = ranks.argmin(1)
            n = np.arange(len(rows))
            best = ranks[n, k]
            open_ = best < NONE
            if not open_.all():
                done[rows[~open_]] = ids[~open_]
                rows, ids, ranks, k, best = rows[open_], ids[open_], ranks[open_], k[open_], best[open_]
                n = np.arange(len(rows))
                if not len(rows):
                    break
            # the pair becomes one id, what follows moves up
            ids[n, k] = self.merged[best]
            ahead = place[None, :] > k[:, None]
            ids = np.where(ahead, np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)[:, 1:], ids)
            ranks = np.where(ahead[:, :-1], np.pad(ranks, ((0, 0), (0, 1)), constant_values=NONE)[:, 1:], ranks)
            right = np.minimum(k + 1, ids.shape[1] - 1)
            at = np.minimum(k, ranks.shape[1] - 1)
            ranks[n, at] = np.where(k + 1 < ids.shape[1], self._pair_ranks(ids[n, k], ids[n, right]), NONE)
            left = k > 0
            ranks[n[left], k[left] - 1] = self._pair_ranks(ids[n[left], k[left] - 1], ids[n[left], k[left]])
        return done

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of the pre-tokenizer, as 32-bit integers.

        All words are cut at their forced boundaries and the parts merged together, in
        groups of like length; very long parts go one by one.
        """
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        if not len(flat):
            return [b""] * len(words)
        ends = np.cumsum([len(x) for x in raw])
        cut = ~self.inside[flat[:-1].astype(np.int64) << 8 | flat[1:]]
        cut[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(flat))] - 1] = True
        starts = np.r_[0, np.flatnonzero(cut) + 1]
        sizes = np.diff(np.append(starts, len(flat)))
        single = self.single_ids[flat]
        counts, held = np.ones(len(starts), np.int64), {}
        shortest = 1
        for most in (1, 4, 8, 12, 16, 24, SHORT):
            part = np.flatnonzero((sizes >= shortest) & (sizes <= most))
            shortest = most + 1
            if not len(part):
                continue
            at = starts[part][:, None] + np.arange(most)[None, :]
            ids = np.where(np.arange(most)[None, :] < sizes[part][:, None], single[np.minimum(at, len(flat) - 1)], -1)
            if most > 1:
                ids = np.concatenate([self._merge_all(ids[i : i + ROWS]) for i in range(0, len(ids), ROWS)])
            counts[part] = (ids >= 0).sum(1)
            held[most] = (part, ids)
        long = np.flatnonzero(sizes > SHORT)
        merged = [np.array(self._merge(flat[starts[i] : starts[i] + sizes[i]].tobytes()), np.int32) for i in long]
        counts[long] = [len(x) for x in merged]
        offsets = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for part, ids in held.values():
            some = ids >= 0
            out[(offsets[part][:, None] + np.arange(ids.shape[1])[None, :])[some]] = ids[some]
        for i, x in zip(long, merged, strict=True):
            out[offsets[i] : offsets[i] + len(x)] = x
        # parts to words
        first = np.searchsorted(starts, ends - [len(x) for x in raw])
        last = np.searchsorted(starts, ends)
        edge = np.append(offsets, len(out)) * 4
        data = out.tobytes()
        return [data[a:b] for a, b in zip(edge[first].tolist(), edge[last].tolist(), strict=True)]

    def _learn(self, texts: set[str]) -> dict[str, bytes]:
        """Ids of new stretches of text, whose words are encoded together."""
        split = {t: (t,) if t[1:].isalpha() and t[0] == " " else self.pattern.findall(t) for t in texts}
        words = list({w for ws in split.values() for w in ws} - self.words.keys())
        made = dict(zip(words, self.encode_words(words), strict=True))
        for w in words:
            if len(self.words) >= CACHE_WORDS:
                break
            if len(w) <= CACHE_LETTERS and w[0] != " ":
                self.words[w] = made[w]
        known = self.words
        return {t: b"".join([made[w] if w in made else known[w] for w in ws]) for t, ws in split.items()}

    def _stretches(self, text: str) -> list[str] | None:
        """The text's fragments after the first, if it falls apart at its spaces alone."""
        rest = text.split(" ")
        if self.spaced and len(rest) > 1 and not any(not x or x[-1].isspace() for x in rest[:-1] if x not in self.fragments):
            return rest
        return None

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as 32-bit integers."""
        known = self.fragments
        plain: list[tuple[int, str | int]] = []
        for n, text in enumerate(texts):
            parts = self.split.split(text) if self.split else [text]
            plain += [(n, self.added[x] if k % 2 else x) for k, x in enumerate(parts) if x]
        new, stretches = set(), []
        for _, x in plain:
            if isinstance(x, int):
                stretches.append(None)
                continue
            found = self._stretches(x)
            stretches.append(found)
            if found is None:
                new.add(x)
                continue
            new.add(found[0])
            # the last fragment may end in white space: it is encoded as it is, and not kept
            if not found[-1] or found[-1][-1].isspace():
                new.add(" " + found[-1])
            new.update(" " + f for f in set(found[1:]).difference(known))
        new.discard("")
        made = self._learn(new)
        for t, ids in made.items():
            if len(known) >= CACHE_WORDS:
                break
            if t[0] == " " and 1 < len(t) <= CACHE_LETTERS and "\n" not in t and not t[-1].isspace() and t.count(" ") == 1:
                known[t[1:]] = ids
        out: list[list[bytes]] = [[] for _ in texts]
        for (n, x), found in zip(plain, stretches, strict=True):
            if isinstance(x, int):
                out[n].append(np.int32(x).tobytes())
            elif found is None:
                out[n].append(made[x])
            else:
                out[n].append(made[found[0]])
                out[n] += [ids if (ids := known.get(f)) is not None else made[" " + f] for f in found[1:]]
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], np.int32).tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens in turn; ids outside the vocabulary have none."""
        ids, out = np.asarray(ids, np.int64), []
        known = (ids >= 0) & (ids < len(self.sizes))
        ids = ids if known.all() else ids[known]
        for at in range(0, len(ids), STEP):
            part = ids[at : at + STEP]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            total = int(ends[-1])
            out.append(self.flat[np.arange(total) + np.repeat(self.starts[part] - (ends - sizes), sizes)].tobytes())
        return b"".join(out)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _parts(batches, field: int, size):
    """(rows, their values of a field) cut to at most BATCH_BYTES, as ``size`` gives them, a row at least."""
    for batch in batches:
        values = batch.column(0).field(field)
        sizes = np.cumsum(size(values))
        at = 0
        while at < len(sizes):
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + BATCH_BYTES)))
            yield batch.column(0).slice(at, to - at), values.slice(at, to - at)
            at = to


def _lengths(column: pa.Array) -> np.ndarray:
    of = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    return of.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _model(vocabulary: dict) -> ForcedBoundaryBPE:
    """The encoder of a broadcast vocabulary, kept beside it for a worker's later tasks."""
    if "model" not in vocabulary:
        vocabulary["model"] = ForcedBoundaryBPE(vocabulary)
    return vocabulary["model"]


def _encode(sent, field):
    def run(batches):
        model = _model(sent.value)
        for rows, texts in _parts(batches, field, _lengths):
            ids = model.encode_batch([x or "" for x in texts.to_pylist()])
            ends = (np.cumsum([0, *map(len, ids)]) // 4).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), np.int32)
            yield pa.RecordBatch.from_arrays([rows, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["row", "ids"])

    return run


def _decode(sent, field):
    def run(batches):
        model = _model(sent.value)
        for rows, ids in _parts(batches, field, _lengths):
            text = [model.decode(x.values.to_numpy() if x.is_valid else ()) for x in ids]
            yield pa.RecordBatch.from_arrays([rows, pa.array(text, pa.string())], names=["row", "decoded"])

    return run


def _apply(df: DataFrame, function, source: str, made: str, kind: str, vocabulary: dict) -> DataFrame:
    """``df`` with the column that ``function`` makes of ``source``; all columns travel with their row."""
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)
    names = {c: f"c{k}" for k, c in enumerate(df.columns) if c != made}
    moved = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    packed = moved.select(F.struct(*names.values()).alias("row"))
    row, field = packed.schema["row"].dataType.simpleString(), list(names).index(source)
    done = packed.mapInArrow(function(sent, field), f"row {row}, {made} {kind}")
    return done.select(*(F.col(f"row.{n}").alias(c) for c, n in names.items()), made)


def encode(docs: DataFrame, vocabulary: dict, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each whole text; a column of that name is replaced."""
    return _apply(docs, _encode, text_col, ids_col, "array<int>", vocabulary)


def decode(encoded: DataFrame, vocabulary: dict, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of each list of ids; a column of that name is replaced."""
    return _apply(encoded, _decode, ids_col, text_col, "string", vocabulary)
