"""Language identification by compression with per-language dictionaries.

Text is lower-cased. A language's model is a zstandard raw-content dictionary
of whole texts in that language. A text is compressed once with each
dictionary, in blocks of ``BLOCK`` bytes and at one level whatever its length,
and goes to the language whose output is smallest. The prediction is rejected
when the runner-up's output is within ``MIN_BYTES`` bytes or ``MIN_SHARE`` of
the best one's.

The learned sample is bounded in rows: of each language at most
``DOCS_PER_LANGUAGE`` in the order of a hash. Texts of up to ``USUAL_BYTES``
come first, longer ones only where a language has too few of those, and none
over what the rows may have together, ``DOCS_PER_LANGUAGE * USUAL_BYTES``
bytes (640 KB): that bounds what is broadcast. No text is cut. A language all of
whose texts are longer than that is not learned.

Null, empty and letterless texts are ``und`` with score 0 and are rejected.
Ties go to the first language by code point and are rejected. Rows without a
language, or without letters, teach nothing. If nothing can be learned every text
is ``und``. Repeated rows are each predicted; long texts are read whole.
Columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siteloom.llm.common import id_crc, rebatched, struct_of

DOCS_PER_LANGUAGE = 160  # learned rows per language at most
USUAL_BYTES = 4096  # of a text that teaches before longer ones do
MOST_BYTES = DOCS_PER_LANGUAGE * USUAL_BYTES  # of a language's dictionary
DEALS = 128  # groups of tasks that choose among themselves first
BLOCK = 16 << 10
LEVEL = 12
MIN_BYTES = 2
MIN_SHARE = 0.01
TEMPERATURE = 6.0
UNKNOWN = "und"

_compressors: dict[int, list] = {}


def held_out(id_column: str) -> Column:
    return F.pmod(id_crc(id_column), F.lit(4)) == 2


def learn(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language.

    Ranks are cut inside each task before any row is shuffled, and only the few
    chosen rows bring their text.
    """
    size, mark = F.octet_length(text), F.xxhash64(F.lit(5), F.col(id_column), F.col(text))
    rows = docs.where(F.col(lang).isNotNull() & (size <= MOST_BYTES) & F.col(text).rlike(r"\p{L}") & ~held_out(id_column))
    rows = rows.select(F.col(lang).alias("lang"), mark.alias("h"), size.alias("bytes"), F.col(text).alias("text"))
    order = (F.col("bytes") > USUAL_BYTES, "h", "bytes")

    def first(of: DataFrame, *key: str) -> DataFrame:
        return of.withColumn("n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where(F.col("n") <= DOCS_PER_LANGUAGE)

    # First among the rows of a few tasks, then among what those leave, so that no task sees the choice of every task.
    dealt = rows.select("lang", "h", "bytes").withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(DEALS)))
    ranked = first(first(dealt, "lang", "deal").drop("n"), "lang")
    total = F.sum(F.col("bytes") + 1).over(W.partitionBy("lang").orderBy("n"))
    chosen = ranked.withColumn("total", total).where(F.col("total") <= MOST_BYTES + F.col("n")).select("lang", "h", "n").collect()
    wanted = sorted({row["h"] for row in chosen})  # DOCS_PER_LANGUAGE numbers a language at most
    if not wanted:
        return {}
    texts = {(r["lang"], r["h"]): r["text"] for r in rows.where(F.col("h").isin(wanted)).select("lang", "h", "text").dropDuplicates(["lang", "h"]).collect()}
    found: dict[str, list[bytes]] = {}
    for row in sorted(chosen, key=lambda r: (r["lang"], r["n"])):
        found.setdefault(row["lang"], []).append(texts[(row["lang"], row["h"])].lower().encode())
    return {k: b"\n".join(v) for k, v in sorted(found.items())}


def _models(dictionaries: dict[str, bytes]) -> list:
    """A compressor for each language."""
    import zstandard

    key = hash(tuple(dictionaries.items()))
    if key not in _compressors:
        out = []
        for content in dictionaries.values():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
        _compressors.clear()
        _compressors[key] = out
    return _compressors[key]


def sizes(dictionaries: dict[str, bytes], text: str) -> list[int]:
    """Compressed bytes of the whole text with each dictionary."""
    data = text.lower().encode()
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    return [sum([len(model.compress(b)) for b in blocks]) for model in _models(dictionaries)]


def judge(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row``, a struct of the columns ``carry`` (all) beside lang_pred, lang_score and lang_rejected.

    A text goes to Python once, and comes back only if it is carried.
    """
    names, carry = list(dictionaries), docs.columns if carry is None else carry
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)
    others, back = [c for c in carry if c != text], text in carry
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others))).alias("own"), F.col(text).alias("text"), letters.alias("letters"))
    schema = T.StructType([rows.schema["own"], *([rows.schema["text"]] if back else []), *struct_of(lang_pred=T.StringType(), lang_score=T.DoubleType(), lang_rejected=T.BooleanType())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rebatched(batches, 16 << 20):
            pred, score, rejected = [], [], []
            for value, known in zip(batch.column("text"), batch.column("letters").to_pylist(), strict=True):
                if not known or not names:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    rejected.append(True)
                    continue
                best, share, unsure = verdict(sizes(model.value, value.as_py()))
                pred.append(names[best])
                score.append(share)
                rejected.append(unsure)
            yield pa.RecordBatch.from_arrays([batch.column("own"), *([batch.column("text")] if back else []), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names)

    found = rows.mapInArrow(classify, schema)
    fields = [F.col("text").alias(c) if c == text else F.col("own")[f"c{others.index(c)}"].alias(c) for c in carry]
    return found.select(F.struct(*fields).alias("row"), "lang_pred", "lang_score", "lang_rejected")


def verdict(found: list[int]) -> tuple[int, float, bool]:
    """Of the compressed sizes: which is least (of equal ones the first), its share, and whether the next is too near."""
    best, rest = int(np.argmin(found)), sorted(found)
    share = float(1 / np.exp((rest[0] - np.asarray(found, float)) / TEMPERATURE).sum())
    return best, share, len(rest) > 1 and rest[1] - rest[0] < max(MIN_BYTES, MIN_SHARE * rest[0])


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``carry``, with lang_pred, lang_score and lang_rejected."""
    found = ("lang_pred", "lang_score", "lang_rejected")
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in found]
    return judge(docs, dictionaries, text, kept).select(*(F.col("row")[c].alias(c) for c in kept), *found)


def sure(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with the prediction as their ``lang``; all other columns stay."""
    kept = judge(docs, dictionaries, text).where("NOT lang_rejected")
    return kept.select(*(F.col("lang_pred").alias(c) if c == lang else F.col("row")[c].alias(c) for c in docs.columns))


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict every row: its id and the prediction."""
    return predict(docs.select(id_column, text), learn(docs, id_column, text, lang), text, [id_column])
