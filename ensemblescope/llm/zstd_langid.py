"""Language by compression: the dictionary of raw text that makes a text smallest names its language."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, set_aside, whole_text

#: Bounds of what is learned: pieces and bytes for each language, and languages.
PIECES = 192
PIECE_CHARS = 512
MOST_LANGUAGES = 1000
#: Texts are encoded in blocks of this many bytes, so that a long text doesn't become its own dictionary.
BLOCK = 4096
#: Rejected are results whose runner-up is less than this share larger.
MARGIN = 0.01
_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def plain(text: str) -> bytes:
    """Lower case; digits and ASCII signs become single blanks."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


class Languages:
    """One raw-content dictionary for each language."""

    def __init__(self, samples: dict[str, list[str]], level: int = 6):
        self.names = sorted(samples)
        texts = {n: [plain(s) for s in samples[n]] for n in self.names}
        # Labels can be wrong: pieces that another language's half of the pieces encodes better leave the dictionaries.
        kept: dict[str, list[bytes]] = {n: [] for n in self.names}
        for fold in (0, 1):
            self.coders = [self._coder(b"\n".join(texts[n][1 - fold :: 2]), level) for n in self.names]
            for k, name in enumerate(self.names):
                for piece in texts[name][fold::2]:
                    sizes = self.sizes(piece)
                    if sizes[k] == min(sizes):
                        kept[name].append(piece)
        self.coders = [self._coder(b"\n".join(kept[n] or texts[n]), level) for n in self.names]

    def _coder(self, content: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def sizes(self, data: bytes) -> list[int]:
        """Bytes of a text under each dictionary."""
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; ``und`` with zeros for a text without letters."""
        if not text or not _LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = np.array(self.sizes(plain(text)), float)
        if len(sizes) == 1:
            return self.names[0], 1.0, 1.0
        order = np.argsort(sizes, kind="stable")
        best, second = sizes[order[0]], sizes[order[1]]
        odds = np.exp2(-(sizes - best) / 2)  # each two bytes saved double the odds
        return self.names[order[0]], float(1 / odds.sum()), float((second - best) / second)


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang", pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, list[str]]:
    """Up to ``pieces`` different pieces of ``piece_chars`` code points for each language that has a label.

    The pieces are those with the smallest hashes of their texts, and begin at a
    place that the hash gives, so the choice doesn't depend on the order of rows.
    Rows without label or text teach nothing. More than 1,000 labels raise
    ValueError, because every text is encoded once for each.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), whole_text(text).alias("text")).where("lang is not null and text != ''")
    rows = rows.withColumn("place", F.xxhash64("text", F.lit(1)))
    begin = F.pmod(F.shiftright("place", 8), F.greatest(F.char_length("text") - piece_chars, F.lit(0)) + 1) + 1
    rows = rows.select("lang", "place", F.substring("text", begin.cast("int"), F.lit(piece_chars)).alias("piece"))
    # Copies of a text are one piece; they meet in every task before the shuffle.
    rows = rows.groupBy("lang", "piece").agg(F.min("place").alias("place"))
    # The rank is limited before the shuffle, in every task.
    best = Window.partitionBy("lang").orderBy("place", "piece")
    chosen = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= pieces)
    counted = chosen.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "piece"))).alias("pieces"))
    found = counted.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r.lang: [p.piece for p in r.pieces] for r in found}


def identify_languages(docs: DataFrame, samples: dict[str, list[str]], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Every row with lang_pred, score, lang_margin and lang_accepted.

    ``lang_pred`` is a learned language, or ``und`` if the text is null, empty or
    has no letter, or if nothing was learned. ``score`` is 0 to 1: every two bytes
    that the best dictionary saves against another double the odds. A result whose
    runner-up is less than ``margin`` larger keeps its language but isn't accepted.
    Equal sizes go to the language first by name. Whole texts are encoded, in
    blocks. Rows are handled one by one; a column called like a result is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast({"samples": samples})
    made = {"lang_pred": "string", "score": "double", "lang_margin": "double", "lang_accepted": "boolean"}
    aside, give_back = set_aside(docs, text)
    kept = aside.select("*", whole_text(text).alias("_whole_text")).drop(*made)
    fields = [f for f in kept.schema.fields if f.name != "_whole_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{n} {t}" for n, t in made.items())])

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "languages" not in held.value:
            held.value["languages"] = Languages(held.value["samples"]) if held.value["samples"] else None
        known = held.value["languages"]
        found = [known.predict(t) if known else ("und", 0.0, 0.0) for t in batch.column("_whole_text").to_pylist()]
        columns = [batch.column(f.name) for f in fields]
        columns += [pa.array([f[0] for f in found], pa.string())] + [pa.array([f[i] for f in found], pa.float64()) for i in (1, 2)]
        columns.append(pa.array([f[0] != "und" and f[2] >= margin for f in found], pa.bool_()))
        return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *made])

    return give_back(map_batches(kept, predict, schema))
