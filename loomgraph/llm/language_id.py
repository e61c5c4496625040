"""Language identification by compression with per-language zstandard dictionaries.

Each language's dictionary is raw content: slices of training texts. A text is encoded in pieces of PIECE bytes with
every dictionary; the language whose dictionary gives the fewest bytes in total wins. A narrow margin over the second
is a rejection, reported beside the best guess.

The dictionaries are fitted on a bounded sample: at most `sample_docs` documents a language, those with the smallest hash of
id and text, a slice of at most SLICE characters of each, `dict_bytes` in all. Every text is predicted whole, however long.

Defined cases: a text that is null or has no letter is `und` with score 0; without any training row every text is
`und`; of equal sizes the language first in order of name wins; repeated rows are each predicted; other columns,
the language of the row and its id are not looked at in a prediction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import byte_column, id_text, ship

PIECE = 4096
SLICE = 1500
LETTER = regex.compile(r"\p{L}")
#: Bytes of lower-cased text: ASCII letters and all of other scripts stay, the rest separates words.
LETTERS_ONLY = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-cased words of letters, one space between."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY).split())


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.langs = sorted(dictionaries)
        self.coders = []
        for lang in self.langs:
            made = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and (second - best) / second."""
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0
        data = plain(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self.coders]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = [s for i, s in enumerate(sizes) if i != best]
        second = min(rest, default=len(data) + 16)
        return self.langs[best], max(0.0, min(1.0, (second - sizes[best]) / second))


def dictionaries(training: DataFrame, sample_docs: int, dict_bytes: int) -> dict[str, bytes]:
    """Raw-content dictionaries from (doc_id, text, lang) rows."""
    rows = training.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    rank = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    start = 1 + F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.greatest(F.lit(1), F.length("text") - SLICE))
    pieces = rows.select("lang", rank.alias("rank"), F.substring("text", start, F.lit(SLICE)).alias("piece"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank", "piece"))

    def smallest(share: dict[str, float]) -> list:
        """At most sample_docs rows of each language, of those whose rank is in the given share; ranks spread rows evenly."""
        limit = F.create_map(*[x for lang, part in share.items() for x in (F.lit(lang), F.lit(int(part * (1 << 30))))])
        return pieces.filter(F.col("rank") < limit[F.col("lang")]).withColumn("at", first).filter(F.col("at") <= sample_docs).collect()

    picked = smallest({lang: min(1.0, 2 * sample_docs / n) for lang, n in counts.items()})
    # Where many rows are equal, their one rank may lie outside the share.
    without = counts.keys() - {r["lang"] for r in picked}
    picked += smallest({lang: 1.0 for lang in without}) if without else []
    parts: dict[str, list[bytes]] = defaultdict(list)
    for r in sorted(picked, key=lambda r: (r["rank"], r["piece"])):
        parts[r["lang"]].append(plain(r["piece"]))
    return {lang: (b" ".join(p)[:dict_bytes] or b" " * 16).ljust(16) for lang, p in parts.items()}


def identify_language(df: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, sample_docs: int = 400, dict_bytes: int = 160_000, margin: float = 0.01) -> DataFrame:
    """Per row of df: doc_id, held_out, lang_pred, score, rejected. training: labelled rows to learn from."""
    learned = dictionaries(id_text(training, id_col, text_col, F.col(lang_col).cast("string").alias("lang")), sample_docs, dict_bytes)
    shared = df.sparkSession.sparkContext.broadcast(learned)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(shared.value)
        for batch in batches:
            made = [model.predict(None if t is None else t.decode("utf-8", "replace")) for t in byte_column(batch, "text")]
            langs, scores = [m[0] for m in made], [m[1] for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([s < margin for s in scores], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = id_text(df, id_col, text_col, (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
