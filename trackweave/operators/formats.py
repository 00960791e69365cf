"""Format options of records: the best audio format, up to three others, and the automatic one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The options that stand in for an unreadable list, and the automatic one.
AUTO_FORMAT = "bestaudio/best"
FALLBACK = [
    (0, "bestaudio/best", "Auto-select Best (Recommended)", "auto", None, True),
    (1, "bestaudio[ext=webm]", "Opus/WebM (High Quality)", "webm", "opus", False),
    (2, "bestaudio[ext=m4a]", "AAC/M4A (Good Quality)", "m4a", "aac", False),
]


def is_audio_only(acodec: Column, vcodec: Column) -> Column:
    none = F.lit("none")
    return (F.coalesce(vcodec, none) == "none") & (F.coalesce(acodec, none) != "none")


def audio_formats(formats: DataFrame) -> DataFrame:
    """Formats (record, pos, ...) with sound alone. Of those with the same id and codec the last counts, at the first's place."""
    return _grouped(formats).where("audio").drop("audio")


def _grouped(formats: DataFrame) -> DataFrame:
    """``audio_formats`` with a column ``audio``, and one row without it for the other formats of each record."""
    audio = is_audio_only(F.col("acodec"), F.col("vcodec"))
    own = formats.select(
        "record", "pos", audio.alias("audio"), F.when(audio, F.col("format_id")).alias("format_id"), F.when(audio, F.col("acodec")).alias("codec"), "ext",
        F.coalesce(S.first_true(F.col("abr"), F.col("tbr"), F.lit(0.0), empty=0), F.lit(0.0)).alias("quality"), S.first_true(F.col("filesize"), F.col("filesize_approx"), empty=0).alias("filesize"))
    return own.groupBy("record", "audio", "format_id", "codec").agg(
        F.min("pos").alias("pos"), F.max_by(F.struct("ext", "quality", "filesize"), "pos").alias("x")).select("record", "audio", "pos", "format_id", "codec", "x.*")


def format_options(formats: DataFrame) -> DataFrame:
    """(record, rank, format_id, label, ext, codec, bitrate, filesize_mb, recommended).

    Rank 0 is the best by quality, the earlier on ties; then come up to three others with another id; the automatic
    choice is last, and recommended only if it is alone. Formats are grouped and ordered by record once: the automatic
    choice comes out of a record's first row.
    """
    order = Window.partitionBy("record").orderBy(F.desc("audio"), F.desc("quality"), "pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _grouped(formats).withColumn("place", F.row_number().over(order)).withColumn("best", F.first("format_id").over(so_far))
    other = F.col("audio") & (F.col("place") > 1) & (F.col("format_id") != F.col("best"))
    ranked = ranked.withColumn("other", other).withColumn("rank", F.sum(F.col("other").cast("long")).over(so_far))
    first = F.col("place") == 1
    ranked = ranked.where(first | F.col("other") & (F.col("rank") <= 3))
    bitrate = F.col("quality").cast("long")
    named = F.concat(F.upper("codec"), F.when(first, ", ").otherwise(" ("), F.lit("~"), bitrate.cast("string"), F.lit("kbps)"))
    label = F.when(first, F.concat(F.lit("Best Quality ("), named)).otherwise(named)
    option = {"rank": F.col("rank"), "format_id": F.col("format_id"), "label": label, "ext": F.col("ext"), "codec": F.col("codec"), "bitrate": bitrate,
              "filesize_mb": S.megabytes(F.col("filesize")), "recommended": first}
    auto = {"rank": F.lit(4).cast("long"), "format_id": F.lit(AUTO_FORMAT), "label": F.lit("Auto-select Best"), "ext": F.lit("auto"), "codec": F.lit(None).cast("string"),
            "bitrate": F.lit(None).cast("long"), "filesize_mb": F.lit(None).cast("double"), "recommended": ~F.col("audio")}
    of = F.when(F.col("audio"), F.struct(*[c.alias(n) for n, c in option.items()]))
    automatic = F.when(first, F.struct(*[c.alias(n) for n, c in auto.items()]))
    return ranked.select("record", F.explode(F.filter(F.array(of, automatic), lambda x: x.isNotNull())).alias("x")).select("record", "x.*")


def fallback_options(records: DataFrame) -> DataFrame:
    """The fixed options for records (record) without any formats."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("rank", "format_id", "label", "ext", "codec", "recommended"), strict=True)]) for r in
                     [(a, b, c, d, e or "", f) for a, b, c, d, e, f in FALLBACK]])
    return records.select("record", F.explode(rows).alias("x")).select("record", "x.*").withColumn("codec", F.nullif("codec", F.lit("")))


def default_format(options: DataFrame) -> DataFrame:
    """Of each record the first recommended option, else the first."""
    return options.groupBy("record").agg(F.min_by("format_id", F.struct((~F.col("recommended")).alias("x"), "rank")).alias("format_id"))
