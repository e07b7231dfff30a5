"""BPE encoding with a queue of merge ranks over a linked list of symbols."""

from __future__ import annotations

import json
import unicodedata
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, set_aside, whole_text

#: White space as Unicode defines it.
_WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def byte_symbols() -> list[str]:
    """One printable character for each byte: itself if printable Latin-1, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file.

    Understood are files of the kind: optional NFC, white space to blanks, lower
    case; pieces by a pattern; bytes as characters; BPE with an end-of-word
    suffix; no decoder. Anything else raises ValueError.
    """

    def __init__(self, source: bytes, cache_words: int = 200_000):
        stated = json.loads(source)
        model = stated["model"]
        steps = [x["type"] for x in (stated["normalizer"] or {}).get("normalizers", [])]
        cuts = [x["type"] for x in stated["pre_tokenizer"].get("pretokenizers", [])]
        if model["type"] != "BPE" or stated["decoder"] or steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"]:
            raise ValueError("not a tokenizer of this kind")
        if any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("an option of this tokenizer's model is not supported")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        number = self.vocabulary
        #: Rank of a pair of ids, and the id that a merge of that rank makes.
        self.ranks = {number[a] << 32 | number[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [number[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.inner = [number.get(c, -1) for c in symbols]
        self.final = [number.get(c + self.suffix, -1) for c in symbols]
        pattern = stated["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _WHITE)
        self.pieces = regex.compile(pattern)
        self.special = {x["content"]: x["id"] for x in stated["added_tokens"]}
        names = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.strings = [names.get(i, "") for i in range(max(names) + 1)]
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.cache_words = cache_words

    def merge(self, word: list[int]) -> list[int]:
        """The ids left when the lowest rank, then the leftmost place, is merged as long as any pair has a rank."""
        rank_of, made, last = self.ranks.get, self.made, len(word)
        after = list(range(1, last + 1))
        before = list(range(-1, last - 1))
        # What the pair that begins at each place would make; an entry of the queue is rank and place in one number.
        makes = [-1] * last
        queue = []
        for i in range(last - 1):
            rank = rank_of(word[i] << 32 | word[i + 1])
            if rank is not None:
                makes[i] = made[rank]
                queue.append(rank << 32 | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            new = made[entry >> 32]
            if makes[i] != new:
                continue  # stale: one of the two symbols has changed since
            j = after[i]
            k = after[j]
            word[i], word[j] = new, -1
            makes[i] = makes[j] = -1
            after[i] = k
            if k < last:
                before[k] = i
                rank = rank_of(new << 32 | word[k])
                if rank is not None:
                    makes[i] = made[rank]
                    heappush(queue, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(word[h] << 32 | new)
                makes[h] = -1 if rank is None else made[rank]
                if rank is not None:
                    heappush(queue, rank << 32 | h)
        return [s for s in word if s >= 0]

    def ids_of(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece, from a cache of two generations."""
        if (known := self.old.get(piece)) is None:
            data = piece.encode()
            word = [self.inner[b] for b in data]
            word[-1] = self.final[data[-1]]
            known = tuple(self.merge([w for w in word if w >= 0]))
        if len(piece) <= 64:
            if len(self.young) >= self.cache_words:
                self.old, self.young = self.young, {}
            self.young[piece] = known
        return known

    def normalise(self, text: str) -> str:
        # Lower case is by character: a capital sigma has no final form.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, text: str) -> list[int]:
        """All ids; the strings of special tokens in a text are those tokens."""
        parts = self.cut_special.split(text) if self.cut_special and any(s in text for s in self.special) else [text]
        ids: list[int] = []
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            pieces = self.pieces.findall(self.normalise(part))
            found = list(map(self.young.get, pieces))
            if None in found:
                found = [self.ids_of(p) if f is None else f for p, f in zip(pieces, found, strict=True)]
            ids.extend(chain.from_iterable(found))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings in a row, parted by blanks as the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))


def _sent(spark: SparkSession, tokenizer: str) -> Broadcast:
    """A tokenizer file, of a few MB, for every worker; each parses it once and keeps its word cache there."""
    with open(tokenizer, "rb") as f:
        return spark.sparkContext.broadcast({"source": f.read()})


def _merges(held: dict) -> Merges:
    if "merges" not in held:
        held["merges"] = Merges(held["source"])
    return held["merges"]


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """Every row with its token ids and, if named, what these ids decode to.

    ``tokenizer`` is the path of a tokenizer file, read once by the driver. A null
    or empty text has no ids and decodes to the empty text. Rows are handled one
    by one: repeated rows repeat, no row moves, and a column of ``docs`` that is
    called like a result is replaced by it.
    """
    held = _sent(docs.sparkSession, tokenizer)
    made = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    aside, give_back = set_aside(docs, text)
    kept = aside.withColumn("_whole_text", whole_text(text)).drop(*made)
    names = [c for c in kept.columns if c != "_whole_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name in names), *(f"`{n}` {t}" for n, t in made.items())])

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges = _merges(held.value)
        rows = [merges.encode(t) for t in batch.column("_whole_text").to_pylist()]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
        values = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
        columns = [batch.column(n) for n in names]
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)))
        if decoded:
            columns.append(pa.array([merges.decode(r) for r in rows], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[*names, *made])

    return give_back(map_batches(kept, encode, schema))


def decode_ids(table: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Every row with the text its ids stand for; null ids give the empty text."""
    held = _sent(table.sparkSession, tokenizer)
    kept = table.drop(decoded)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"`{decoded}` string"])

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges = _merges(held.value)
        texts = pa.array([merges.decode(r or []) for r in batch.column(ids).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, decoded])

    return map_batches(kept, decode, schema)


def token_digests(encoded: DataFrame, ids: str = "ids", decoded: str = "decoded") -> list:
    """Columns: number of ids, digest of the ids as decimals, digest of the decoded text."""
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
