"""Row-wise features: dates, bins, text measures, flags, scores.

All functions return columns or add columns; none of them shuffles, except those that impute or
scale with a statistic of the train rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.medians import medians
from reviewlens.session import cut_lineage

# The eight genres of the multi-hot, in their order.
GENRES = ("Drama", "Comedy", "Action", "Mystery", "Fantasy", "Romance", "Horror", "Documentary")

# Bin edges (right-closed) and the category that stands for NULL.
TARGET_MEAN_EDGES = (0.0, 0.33, 0.67, 1.01)
RUNTIME_EDGES = (0.0, 90.0, 120.0, 150.0, 1000.0)
MISSING = "missing"

# Placeholders of the tagged row text.
PLACEHOLDERS = {
    "title": "[NO_TITLE]",
    "info": "[NO_INFO]",
    "genres": "[NO_GENRES]",
    "directors": "[NO_DIRECTORS]",
    "production_company": "[NO_PRODUCTION]",
    "critic": "[NO_CRITIC]",
    "publisher": "[NO_PUBLISHER]",
    "content_rating": "[NO_RATING]",
}


def to_date(text: Column | str) -> Column:
    """Date of a text; NULL where the text is not a date."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text).cast("date")


def date_parts(date: str, prefix: str) -> dict[str, Column]:
    """Year, month and day of week (Monday = 0)."""
    return {
        f"{prefix}_year": F.year(date),
        f"{prefix}_month": F.month(date),
        f"{prefix}_dayofweek": F.weekday(date),
    }


def age_days(later: str, earlier: str) -> Column:
    days = F.datediff(later, earlier)
    return F.when(days >= 0, days)


def genre_flags(genres: str, names: tuple[str, ...] = GENRES) -> dict[str, Column]:
    text = F.lower(F.coalesce(F.col(genres), F.lit("")))
    return {f"genre_{g}": F.contains(text, F.lit(g.lower())).cast("int") for g in names}


def fill_missing(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def fill_train_median(df: DataFrame, train: DataFrame, name: str) -> DataFrame:
    """Fill NULL with the train median; nothing is filled when train itself has no NULL. NaN and infinities are no values of the median."""
    column = cut_lineage(train.select(F.col(name).cast("double").alias("x")))
    fill = medians(column.select(F.array("x").alias("x")), "x").get(0) if column.filter("x IS NULL").limit(1).count() else None
    return df.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(fill).cast("double")))


def right_closed_bin(value: Column | str, edges: tuple[float, ...], default: int = 1) -> Column:
    """Index of the interval (a, b] that holds the value; ``default`` outside of all of them."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.lit(float(default))
    for i in reversed(range(len(edges) - 1)):
        out = F.when((value > edges[i]) & (value <= edges[i + 1]), F.lit(float(i))).otherwise(out)
    return out


def age_bin(days: str) -> Column:
    # Limits in days.
    d = F.col(days)
    return (
        F.when(d.isNull() | (d < 0), 0).when(d < 365, 1).when(d < 1825, 2).when(d < 7300, 3).otherwise(4)
    )


def decade(year: str, default: int = 1990) -> Column:
    return F.coalesce((F.floor(F.col(year) / 10) * 10).cast("int"), F.lit(default))


def text_length(name: str) -> Column:
    return F.length(fill_missing(name))


def word_count(name: str) -> Column:
    return F.size(F.filter(F.split(fill_missing(name), r"\s+"), lambda t: t != ""))


def missing_flag(name: str) -> Column:
    return F.col(name).isNull().cast("int")


def product(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") * b.cast("double")


def scale_by_train_range(df: DataFrame, train: DataFrame, name: str, out: str) -> DataFrame:
    """(x - min) / max(max - min, 1) with the range of train."""
    span = train.agg(
        F.struct(F.min(name).alias("lo"), F.max(name).alias("hi")).alias("range")
    ).scalar()
    df = df.withColumn("_range", span)
    width = F.greatest((F.col("_range.hi") - F.col("_range.lo")).cast("double"), F.lit(1.0))
    return df.withColumn(out, (F.col(name) - F.col("_range.lo")) / width).drop("_range")


def title_and_info(title: str, info: str) -> Column:
    # The template of the text.
    return F.concat(
        F.lit("Title: "), F.coalesce(F.col(title), F.lit("")), F.lit(". "), F.coalesce(F.col(info), F.lit(""))
    )


def tagged_text(columns: dict[str, str], placeholders: bool = True) -> Column:
    """Row text with a tag in front of each field. ``columns`` maps field name to column name."""

    def field(name: str) -> Column:
        gap = F.lit(PLACEHOLDERS[name] if placeholders else "")
        if name not in columns:
            return gap
        return F.coalesce(F.trim(F.col(columns[name]).cast("string")), gap)

    top = F.lit("False")
    if "top_critic" in columns:
        top = F.initcap(F.col(columns["top_critic"]).cast("string"))
    # Tags and their order.
    fields = [
        ("[MOVIE]", field("title")),
        ("[INFO]", field("info")),
        ("[GENRES]", field("genres")),
        ("[DIRECTORS]", field("directors")),
        ("[PRODUCTION]", field("production_company")),
        ("[CRITIC]", field("critic")),
        ("[TOP_CRITIC]", top),
        ("[PUBLISHER]", field("publisher")),
        ("[CONTENT]", field("content_rating")),
    ]
    return F.trim(F.concat_ws(" ", *[x for tag, value in fields for x in (F.lit(tag), value)]))


def list_size(name: str, sep: str = ",") -> Column:
    """Entries of a delimited string; NULL has none."""
    return F.coalesce(F.size(F.filter(F.split(F.col(name), sep), lambda t: F.trim(t) != "")), F.lit(0))


def first_of_list(name: str, sep: str = ",") -> Column:
    return F.trim(F.split(F.col(name), sep)[0])


def token_estimate(text: str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2).cast("int"))


def embedding_cost(texts: DataFrame, text: str, price_per_million: float, batch: int = 200) -> DataFrame:
    """One row: texts, tokens, request batches and cost of embedding all texts. Fixed value: texts of a batch."""
    return texts.agg(F.count(F.lit(1)).alias("texts"), F.sum(token_estimate(text)).alias("tokens")).select(
        "texts",
        "tokens",
        F.ceil(F.col("texts") / batch).alias("batches"),
        (F.col("tokens") / 1e6 * price_per_million).alias("cost"),
    )


def clean_score(score: Column | str) -> Column:
    """Clip to [0, 1]; NaN and NULL become 0.5, infinities the nearest bound."""
    score = F.col(score) if isinstance(score, str) else score
    score = score.cast("double")
    return F.when(score.isNull() | F.isnan(score), 0.5).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    )


def outcome_columns(label: str, score: str, threshold: float = 0.5) -> dict[str, Column]:
    hit = (F.col(score) >= threshold).cast("int")
    return {
        "pred_label": hit,
        "correct": (hit == F.col(label)).cast("int"),
        "outcome": F.when(F.col(label) == 1, F.when(hit == 1, "TP").otherwise("FN")).otherwise(
            F.when(hit == 1, "FP").otherwise("TN")
        ),
    }


def clip_ratio(ratio: Column, top: float = 1e6) -> Column:
    return F.least(F.lit(float(top)), F.greatest(F.lit(0.0), ratio))


def safe_ratio(a: Column, b: Column, default: float = 1.0) -> Column:
    """a / b where b is not zero and both are known, else ``default``."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float(default)))


def is_confident(score: str, high: float = 0.95, low: float = 0.05) -> Column:
    return (F.col(score) >= high) | (F.col(score) <= low)


def confidence(score: str) -> Column:
    return F.greatest(F.col(score), 1 - F.col(score))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
