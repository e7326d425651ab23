"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from panelworks.llm.staging import bound_batches

UNDETERMINED = "und"
#: Size of a language's dictionary, the bound on what is fitted on. Texts give their first PARTS[0] code points; if a
#: language's texts don't fill the dictionary so, they give more.
DICTIONARY, PARTS = 64 * 1024, (4096, 8192, 16384, 32768, 65536)
LEVEL = 6
#: A text is rejected if the best language saves less than this share of the second best's size. Texts under SHORT
#: bytes can't show a margin and are only rejected if they have no letter.
MARGIN, SHORT = 0.001, 128
#: Bytes of a piece of a text. Each is compressed from the fresh dictionary, so that a margin does not fall with length.
PIECE = 4096


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that nothing is learned from: remainder 2 of the CRC-32 of the id as text, modulo 4."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def learn_dictionaries(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> dict[str, bytes]:
    """Raw-content dictionaries by language, most frequent language first, from labelled rows that are not held out.

    Labels are counted over all rows. All labelled rows, whatever their length, are ordered by a hash and fill the
    dictionary up to DICTIONARY bytes; of a long text its beginning enters. No labelled text: no language.
    """
    labelled = docs.where(~held_out(id_column) & F.col(lang_column).isNotNull() & (F.length(text_column) > 0)).select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang")
    )
    given = [F.sum(F.least(F.octet_length("text"), F.lit(part)) + 1).alias(f"given_{part}") for part in PARTS]
    counts = labelled.groupBy("lang").agg(F.count("*").alias("count"), *given).orderBy(F.desc("count"), "lang").collect()
    made: dict[str, bytearray] = {row["lang"]: bytearray() for row in counts}
    shares = {}
    for row in counts:
        part = next((part for part in PARTS if row[f"given_{part}"] >= DICTIONARY), PARTS[-1])
        shares[row["lang"]] = (part, min(1.0, 4 * DICTIONARY / row[f"given_{part}"]))
    hashed = labelled.withColumn("hash", F.xxhash64("id", "text")).withColumn("place", F.pmod("hash", F.lit(1 << 30)) / (1 << 30))
    while shares:
        # Only rows under the hash threshold of their language are ordered; a row gives two bytes at least.
        limits = F.create_map(*[F.lit(v) for lang, (part, share) in shares.items() for v in (lang, share)])
        parts = F.create_map(*[F.lit(v) for lang, (part, share) in shares.items() for v in (lang, part)])
        drawn = hashed.where(F.col("place") <= limits[F.col("lang")]).withColumn("text", F.substring("text", F.lit(1), parts[F.col("lang")]))
        first = Window.partitionBy("lang").orderBy("place", "hash", "id", "text")
        ranked = drawn.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= DICTIONARY // 2)
        before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("rank")) - F.octet_length("text") - 1
        for row in ranked.withColumn("before", before).where(F.col("before") < DICTIONARY).orderBy("lang", "rank").collect():
            text = row["text"].lower().encode() + b"\n"
            made[row["lang"]] += text[: DICTIONARY - len(made[row["lang"]])]
        shares = {lang: (part, min(1.0, 8 * share)) for lang, (part, share) in shares.items() if share < 1 and len(made[lang]) < DICTIONARY}
        for lang in shares:
            made[lang].clear()
    # A dictionary has eight bytes at least.
    return {lang: bytes(text) * -(-8 // len(text)) for lang, text in made.items()}


def predict_language(text: Column, dictionaries: dict[str, bytes], level: int = LEVEL) -> Column:
    """A struct ``lang, score, margin, size`` of a text column.

    The whole text, in lower case, is compressed with each dictionary in pieces of PIECE bytes, each from the fresh
    dictionary, and the smallest sum names the language; of equal sums the language with more labelled rows. ``margin`` is what that saves against the second, as a share
    of its size, ``score`` is margin / (margin + 0.01) brought to 0.5..1, and ``size`` the text's bytes. Texts that are
    null or have no letter are ``und`` with score 0, and so is everything if no language was learned; with one language
    the margin is 1.
    """

    @pandas_udf("lang string, score double, margin double, size long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letter = regex.compile(r"\p{L}")
        coders = []
        for lang, content in dictionaries.items():
            prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(level=level)
            coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=prepared, write_checksum=False)))
        for texts in batches:
            rows = []
            for text in texts:
                if not isinstance(text, str) or not coders or not letter.search(text):
                    rows.append((UNDETERMINED, 0.0, 0.0, 0))
                    continue
                data = text.lower().encode()
                pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
                sizes = sorted((sum(len(coder.compress(piece)) for piece in pieces), i) for i, (_, coder) in enumerate(coders))
                margin = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
                rows.append((coders[sizes[0][1]][0], 0.5 + 0.5 * margin / (margin + 0.01), margin, len(data)))
            yield pd.DataFrame(rows, columns=["lang", "score", "margin", "size"])

    return predict(text)


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin`` of every row. Labels, sources and ids don't enter a prediction.

    Each row of repeated ones gets its own, equal result; a null id counts as not held out; an empty table gives none.
    """
    found = predict_language(F.col(text_column), learn_dictionaries(docs, id_column, text_column, lang_column))
    rows = docs.select(F.col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.margin")


def keep_identified(
    docs: DataFrame, margin: float = MARGIN, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` whose language is clear, unchanged: not ``und``, and no narrow margin from SHORT bytes on."""
    bound_batches(docs.sparkSession)
    found = predict_language(F.col(text_column), learn_dictionaries(docs, id_column, text_column, lang_column))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found.alias("found"))
    clear = (F.col("found.size") < SHORT) | (F.col("found.margin") >= margin)
    return rows.where((F.col("found.lang") != UNDETERMINED) & clear).select("row.*")
