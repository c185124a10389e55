"""Feature encoding for retail facts: fitted once on training rows, applied anywhere."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseek.functions.calendar import date_parts
from tallyseek.operators.corpus_stats import keyed_normals
from tallyseek.operators.positions import with_position
from tallyseek.operators.retail import event_group
from tallyseek.operators.sizing import attach

TARGET = "Purchase_Quantity"
NUMERIC = (
    "Unit_Price", "Num_Customers", "Sales", "Stocks", "Shelf_Life", "Days_Until_Next_Purchase",
)
CATEGORICAL = ("Product", "Day_of_Week", "Weather", "Category")

# Category lists for scoring without a fitted recipe.
FIXED_CATEGORIES = {
    "Day_of_Week": [
        "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    ],
    "Season": ["Winter", "Spring", "Summer", "Autumn"],
    "Weather": ["Sunny", "Rainy", "Snowy", "Cloudy", "Stormy", "Hot", "Cold"],
    "Category": ["Dairy", "Meat", "Vegetables", "Fruits", "Seafood"],
    "Event": ["Holiday", "Daily event", "Promotion", "None"],
}


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """`column, code`: distinct values in sorted order, from 0."""
    return with_position(df.select(column).distinct(), [column], "code")


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add the code of each value; the code table is small or joined skew-safe."""
    codes = label_codes(df.filter(F.col(column).isNotNull()), column)
    return attach(df, codes.withColumnRenamed("code", name or f"{column}_Encoded"), column)


def fixed_code(value: Column, classes: list[str]) -> Column:
    """Code by list position; a value outside the list is an error."""
    return _require(F.array_position(F.array(*map(F.lit, classes)), value) - 1, value, classes)


def categories_of(df: DataFrame, columns: tuple[str, ...]) -> dict[str, list[str]]:
    """Sorted distinct values of each column, in one pass.

    The values become feature names, so they are bound by the width of a feature vector.
    """
    return {c: sorted(counts) for c, counts in category_counts(df, columns).items()}


def category_counts(df: DataFrame, columns: tuple[str, ...]) -> dict[str, dict[str, int]]:
    """Rows of each value of each column, nulls left out: a row's values are counted together before they are told apart."""
    names = [f"_c{i}" for i in range(len(columns))]
    together = df.select(*[F.col(c).cast("string").alias(n) for c, n in zip(columns, names)]).groupBy(*names).agg(F.count("*").alias("rows"))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(n).alias("value")) for c, n in zip(columns, names)])
    single = together.select("rows", F.inline(cells)).filter(F.col("value").isNotNull())
    found = single.groupBy("name", "value").agg(F.sum("rows").alias("rows")).collect()
    return {c: {row.value: row.rows for row in found if row.name == c} for c in columns}


def one_hot(
    value: Column, name: str, categories: list[str], unknown: str = "error"
) -> dict[str, Column]:
    """0/1 columns `name_category` for all but the first category.

    `unknown="error"` fails on other values, `unknown="keep"` gives them zeros.
    """
    checked = value
    if unknown == "error":
        checked = F.when(_is_known(value, categories), value).otherwise(
            F.raise_error(F.concat(F.lit(f"unknown {name}: "), F.coalesce(value, F.lit("null"))))
        )
    return {
        f"{name}_{category}": F.coalesce((checked == category).cast("double"), F.lit(0.0))
        for category in categories[1:]
    }


def _is_known(value: Column, categories: list[str]) -> Column:
    return F.coalesce(value.isin(categories), F.lit(False))


def _require(code: Column, value: Column, classes: list[str]) -> Column:
    return F.when(_is_known(value, classes), code.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(value, F.lit("null")))).cast("int")
    )


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation for each column; no deviation gives 0."""
    stats = df.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in columns],
    )
    return df.withColumns(
        {
            c: scaled(F.col(c), stats.select(f"{c}_mean").scalar(), stats.select(f"{c}_std").scalar())
            for c in columns
        }
    )


def scaled(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (value - mean) / deviation).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Recipe:
    """What the training rows taught: categories, means and deviations."""

    with_event: bool
    categories: dict[str, list[str]]
    means: dict[str, float]
    deviations: dict[str, float]

    @property
    def columns(self) -> list[str]:
        return list(self.means)

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> "Recipe":
        return Recipe(**json.loads(text))

    def values(self, unknown: str = "keep") -> Column:
        """The scaled features of a fact row as one array, in the order of `columns`."""
        raw = encoded_columns(self.categories, self.with_event, unknown)
        return F.array(
            *[
                scaled(raw[c], F.lit(self.means[c]), F.lit(self.deviations[c]))
                for c in self.columns
            ]
        )

    def transform(
        self,
        facts: DataFrame,
        unknown: str = "keep",
        noise_key: Column | None = None,
        level: float = 0.1,
        seed: int = 42,
    ) -> DataFrame:
        """Facts plus the vector `features`, noisy when a row key is given."""
        values = self.values(unknown)
        if noise_key is not None:
            facts = facts.withColumn("_noise_key", noise_key)
            values = noisy(values, F.col("_noise_key"), level, seed)
        return facts.withColumn("features", array_to_vector(values)).drop("_noise_key")


def noisy(values: Column, key: Column, level: float = 0.1, seed: int = 42) -> Column:
    """Add N(0, level) to every element; the draw depends on key, place and seed only."""
    drawn = keyed_normals(key.cast("string"), F.size(values), F.lit(seed))
    return F.zip_with(values, drawn, lambda value, draw: value + level * draw)


def encoded_columns(
    categories: dict[str, list[str]], with_event: bool, unknown: str
) -> dict[str, Column]:
    """Feature name to expression over fact columns, before scaling."""
    out: dict[str, Column] = {c: F.col(c).cast("double") for c in NUMERIC}
    out |= {c: part.cast("double") for c, part in date_parts(F.col("Date")).items()}
    seasons = F.array(*map(F.lit, categories["Season"]))
    out["Season_Encoded"] = (F.array_position(seasons, F.col("Season")) - 1).cast("double")
    for c in CATEGORICAL:
        out |= one_hot(F.col(c), c, categories[c], unknown)
    if with_event:
        grouped = event_group(F.col("Event"), keep_grouped=True)
        out |= one_hot(grouped, "Event_Grouped", categories["Event_Grouped"], unknown)
    return out


def fact_columns(with_event: bool) -> list[str]:
    """The fact columns a recipe reads."""
    event = ["Event"] if with_event else []
    return ["Date", "Season", *NUMERIC, *CATEGORICAL, *event]


def fit_recipe(train: DataFrame, with_event: bool = False) -> Recipe:
    """Learn categories and scales from training rows: two aggregations, few numbers back.

    A 0/1 feature's scale follows from its value's count; a missing number is an error, as it is in a vector.
    """
    facts = train
    names = ("Season", *CATEGORICAL)
    if with_event:
        facts = facts.withColumn("Event_Grouped", event_group(F.col("Event"), keep_grouped=True))
        names = (*names, "Event_Grouped")
    counts = category_counts(facts, names)
    categories = {c: sorted(values) for c, values in counts.items()}
    raw = encoded_columns(categories, with_event, "keep")
    shares = {f"{c}_{value}": counts[c][value] for c in names[1:] for value in categories[c][1:]}
    numbers = [c for c in raw if c not in shares]
    values = facts.select(*[F.coalesce(raw[c], F.raise_error(F.lit(f"no number: {c}")).cast("double")).alias(c) for c in numbers])
    stats = values.agg(
        F.count("*").alias("_rows"), *[F.avg(c).alias(f"mean {c}") for c in numbers], *[F.var_pop(c).alias(f"variance {c}") for c in numbers]
    ).first()
    if not stats["_rows"]:
        raise ValueError("no training rows")
    shares = {c: rows / stats["_rows"] for c, rows in shares.items()}
    means = {c: shares[c] if c in shares else float(stats[f"mean {c}"]) for c in raw}
    variances = {c: shares[c] * (1 - shares[c]) if c in shares else float(stats[f"variance {c}"]) for c in raw}
    return Recipe(with_event, categories, means, {c: variance**0.5 for c, variance in variances.items()})
