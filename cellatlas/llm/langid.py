"""Language by compression: the language whose dictionary makes a text smallest.

Each language has a few zstandard dictionaries of raw content, all of one size, from slices that are spread over all its
sampled texts. Texts are lower-cased and reduced to words of letters. A text is compressed in blocks, so that the
dictionary counts throughout, and each block behind a piece of the dictionary itself, which costs a few bytes and keeps
zstandard from storing a short block as it is. The mean over a language's dictionaries is its size of a text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import appended, documents, fresh, slices, texts, written
from .labelled import held_out, sampled

#: Bounds of the sample that is learned from: texts of a language, and languages.
ROWS, LANGUAGES = 400, 256
DICTIONARIES, DICTIONARY, SLICE = 2, 64 << 10, 256  # of a language; bytes of one, and of the slices that it has
BLOCK, LEAD = 8 << 10, 128
#: A margin (bytes saved over the second language, by the square root of the text's bytes) below this is narrow. What
#: chance saves grows with that root: on held-out documents it is the same bound for 300 bytes and for 30,000.
NARROW = 0.2
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


class Guess(NamedTuple):
    lang: str
    score: float
    margin: float
    accepted: bool


def letters(text: str) -> bytes:
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "replace")


def spread(raw: bytes, share: float) -> list[bytes]:
    """Slices of SLICE bytes or so, spread evenly over all of raw; together `share` of it."""
    n = max(1, math.ceil(len(raw) * share / SLICE))
    size = math.ceil(len(raw) * min(1.0, share) / n)
    return [raw[i * len(raw) // n : i * len(raw) // n + size] for i in range(n)]


def shares(total: dict[str, int]) -> dict[str, float]:
    """What share of each language's bytes of letters fits its dictionaries."""
    return {lang: min(1.0, DICTIONARIES * DICTIONARY / n) for lang, n in total.items() if n}


def dealt(parts: dict[str, list[list[bytes]]]) -> dict[str, tuple[int, list[bytes]]]:
    """For each language the number of texts, and its dictionaries, from the slices of each text in turn."""
    out = {}
    for lang, own in sorted(parts.items()):
        slices_ = [x for text in own for x in text]
        out[lang] = (len(own), [b" ".join(slices_[k::DICTIONARIES] or slices_)[: 2 * DICTIONARY] for k in range(DICTIONARIES)])
    return out


def fit(rows: list[tuple[str, str]]) -> dict[str, tuple[int, list[bytes]]]:
    """A model from (language, text)."""
    raw = [(lang, x) for lang, text in rows if (x := letters(text))]
    total: dict[str, int] = {}
    for lang, x in raw:
        total[lang] = total.get(lang, 0) + len(x)
    share, parts = shares(total), {}
    for lang, x in raw:
        parts.setdefault(lang, []).append(spread(x, share[lang]))
    return dealt(parts)


class Languages:
    """A fitted model, ready in a worker process."""

    def __init__(self, model: dict[str, tuple[int, list[bytes]]]):
        self.langs = list(model)
        total = sum(n for n, _ in model.values())
        self.bias = [-math.log(n / total) / 1000 for n, _ in model.values()]  # decides between equal sizes only
        self.by = [[self.compressor(d) for d in ds] for _, ds in model.values()]

    @staticmethod
    def compressor(content: bytes):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress, content[-300 - LEAD : -300] or content[:LEAD]

    def sizes(self, raw: bytes) -> list[float]:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c(lead + b)) for c, lead in by for b in blocks) / len(by) for by in self.by]

    def guess(self, text: str) -> Guess:
        raw = letters(text)
        if not raw or not self.langs:
            return Guess(UNKNOWN, 0.0, 0.0, False)
        sizes = [s + b for s, b in zip(self.sizes(raw), self.bias, strict=True)]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = order[0]
        margin = (sizes[order[1]] - sizes[best]) / math.sqrt(len(raw)) if len(order) > 1 else 1.0
        score = 1 / sum(math.exp(max(-50.0, 0.7 * (sizes[best] - s))) for s in sizes)
        return Guess(self.langs[best], score, margin, margin >= NARROW)


def learned(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict:
    """A model of the rows that are not held out, of at most ROWS whole texts of each of LANGUAGES languages.

    Languages beyond the LANGUAGES most frequent are not learned. Texts stay on the executors: what comes to the driver
    is the slices, DICTIONARIES * DICTIONARY bytes of a language. Rows with a null lang or text are left out; texts that
    repeat count once; an empty table gives a model without languages.
    """
    few = written(sampled(df.filter(~held_out(doc_id)), lang, text, ROWS, LANGUAGES).select("label", "r", "text"), "language-sample")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(letters(x)) for x in texts(batch)], pa.int64())], names=["label", "n"])

    share = shares({r["label"]: r["n"] for r in few.select("label", "text").mapInArrow(sizes, "label string, n bigint").groupBy("label").agg(F.sum("n").alias("n")).collect()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [spread(x, share[k]) if (x := letters(t)) else None for k, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["label", "r", "parts"])

    parts: dict[str, list[list[bytes]]] = {}
    rows = few.select("label", "r", "text").mapInArrow(cut, "label string, r int, parts array<binary>").filter("parts IS NOT NULL").collect()
    for r in sorted(rows, key=lambda r: (r["label"], r["r"])):
        parts.setdefault(r["label"], []).append([bytes(x) for x in r["parts"]])
    return dealt(parts)


def with_language(df: DataFrame, model: dict, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with lang_pred, lang_score, lang_margin and lang_accepted, from whole texts alone.

    A null text, an empty one, one without a letter, and any text if the model has no language give `und`, score 0, not
    accepted. Where sizes tie, the language with more sampled texts wins, then the first by name; a tie is a narrow
    margin. Long texts are compressed whole, in blocks. Repeated rows get the same each, an empty table gives an empty
    one. Columns of these names give way.
    """
    names = ("lang_pred", "lang_score", "lang_margin", "lang_accepted")
    kinds = (StringType(), DoubleType(), DoubleType(), BooleanType())
    kept = [f for f in df.schema.fields if f.name not in names and (keep_text or f.name != text)]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(shared.value)
        for batch in slices(batches, column=text):
            found = [languages.guess(x) for x in texts(batch, text)]
            arrays = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield appended(batch, dict(zip(names, arrays, strict=True)), () if keep_text else (text,))

    return df.mapInArrow(guess, StructType([*kept, *map(StructField, names, kinds)]))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, a row for a row; learned from rows that are not held out.

    Nulls, empty and long texts, ties, repeated rows and empty tables as with_language states. Other columns than
    doc_id, text and (for learning) lang are not read.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = with_language(docs.select("doc_id", "text"), learned(docs), keep_text=False)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_accepted").alias("accepted"))


def langid_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told with no narrow margin; lang and the other columns stay as they are.

    Documents without a letter go. Columns that clash with those of with_language are set aside meanwhile, so none is lost.
    """
    names = {c: fresh(docs, f"own_{i}") for i, c in enumerate(docs.columns)}
    told = with_language(docs.withColumnsRenamed({c: n for c, n in names.items() if c != "text"}), learned(docs))
    return told.filter("lang_accepted").select(*[F.col("text" if c == "text" else n).alias(c) for c, n in names.items()])
