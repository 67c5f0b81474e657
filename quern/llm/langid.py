"""Language identification by compression.

A text belongs to the language whose sample text, as a raw-content zstandard dictionary, makes
it compress best. Texts are compressed in pieces, so that the dictionary and not the text's own
earlier part decides, and every piece of the whole text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import materialize, small_batches, tidy

UNKNOWN = "und"
#: Bytes of sample text of a language, and of all languages together, which share them if there are many; characters of a document in a sample.
DICT_BYTES, ALL_BYTES = 112 << 10, 32 << 20
CHARS_A_DOC = 1024
PIECE_CHARS = 2048
#: Compression levels: a fast one, and a thorough one where the fast one's margin is below CLEAR_MARGIN.
LEVELS = (3, 10)
CLEAR_MARGIN = 0.05
#: Texts whose best two languages then differ by a smaller share, or by fewer bytes, than this are rejected.
REJECT_MARGIN = 0.015
REJECT_BYTES = 4
#: Shorter texts often tie in any language: they are only rejected for letters that no sample has.
SHORT_BYTES = 64
#: Margin that counts as certain.
FULL_MARGIN = 0.08

_LETTER = regex.compile(r"\p{L}")


def learn_dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Sample text of every language, from a bounded sample of the labelled documents, the language with most documents first.

    A language has DICT_BYTES of it, or its share of ALL_BYTES if languages are many. Documents are drawn by
    a hash of their id, and of a longer one CHARS_A_DOC characters from a place that the hash draws, too.
    Null languages and blank texts teach nothing; an empty table gives no language.
    """
    draw, n = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.length(text_col)
    start = F.pmod(draw, F.greatest(n - CHARS_A_DOC + 1, F.lit(1))).cast("int") + 1
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(F.col(text_col))) > 0)).select(
        F.col(lang_col).alias("lang"), F.lower(F.substring(F.col(text_col), start, F.lit(CHARS_A_DOC))).alias("text"), draw.alias("draw")
    )
    counts = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.avg(F.octet_length("text")).alias("size")))
    each = min(DICT_BYTES, ALL_BYTES // max(1, counts.count()))
    every = counts.select("lang", F.greatest(F.lit(1), F.floor(F.col("count") * F.col("size") / (4 * each))).alias("every"))
    thin = rows.join(F.broadcast(every), "lang").where(F.pmod("draw", "every") == 0).groupBy("lang", "text").agg(F.min("draw").alias("draw"))
    upto = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("draw", "text").rowsBetween(Window.unboundedPreceding, 0))  # about four samples
    drawn = thin.withColumn("upto", upto - F.octet_length("text")).where(F.col("upto") <= each).orderBy("lang", "draw", "text")
    samples: dict[str, list[str]] = {}
    for row in drawn.collect():  # ALL_BYTES, and a text for each language
        samples.setdefault(row["lang"], []).append(row["text"])
    order = [row["lang"] for row in counts.orderBy(F.desc("count"), "lang").select("lang").collect()]
    return {lang: "\n".join(samples[lang]).encode()[-each:] for lang in order if lang in samples}


class Scorer:
    """Compresses lower-cased texts with each language's dictionary; of equal sizes the first language wins."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.letters = set().union(*(_LETTER.findall(x.decode(errors="ignore")) for x in dictionaries.values()))
        self.packers = [[self._packer(dictionaries[lang], level) for lang in self.langs] for level in LEVELS]

    @staticmethod
    def _packer(sample: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False)

    def _ranked(self, packers: list[zstandard.ZstdCompressor], pieces: list[bytes]) -> tuple[str, float, bool]:
        sizes = sorted((sum(len(p.compress(x)) for x in pieces), n) for n, p in enumerate(packers))
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        margin = 1.0 - sizes[0][0] / sizes[1][0]
        return self.langs[sizes[0][1]], margin, margin < REJECT_MARGIN or sizes[1][0] - sizes[0][0] < REJECT_BYTES

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is rejected."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        text = text.lower()
        pieces = [text[i : i + PIECE_CHARS].encode() for i in range(0, len(text), PIECE_CHARS)]
        for packers in self.packers:
            lang, margin, unclear = self._ranked(packers, pieces)
            if margin >= CLEAR_MARGIN:
                break
        if len(text.encode()) < SHORT_BYTES:
            unclear = not self.letters.issuperset(_LETTER.findall(text))
        return lang, min(1.0, margin / FULL_MARGIN), unclear


def predict_languages(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected.

    A null text or one without letters is `und` with score 0 and rejected, as is every text if no
    language was learned, or one that fits no language clearly better than another; one under
    SHORT_BYTES only if it has letters that no language's sample has. Equal sizes go to the language with more documents. Very long texts count
    whole, piece by piece. Repeated rows and null ids are kept, an empty table gives an empty result,
    and other columns are not read.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = [scorer(x) for x in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(tidy(run), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def drop_unidentified(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The documents whose language is not rejected, with all their columns, by the rules of predict_languages().

    Null texts and those without letters go; short ones stay unless no sample has their letters. Repeated
    rows are judged alike, null ids don't matter, and an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    scorers: list[Scorer] = []

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        if not scorers:
            scorers.append(Scorer(held.value))
        return texts.map(lambda x: not scorers[0](x)[2]).astype(bool)

    return docs.where(accepted(F.col(text_col)))
