"""Small helpers of the operators in this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space: the bytes at which ``bytes.split()`` splits.
SPACE = " \t\n\x0b\x0c\r"
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from now on in this session: each running task holds several copies of one."""
    spark = df.sparkSession
    now = spark.conf.get(ARROW).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(ARROW, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text as a string that is never NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def count_words(text: Column, between: str) -> Column:
    """Words of a text that is never NULL; ``between`` matches what stands between words. A split, with sentinels at both ends."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return (F.size(F.split(padded, between, -1)) - 2).cast("bigint")


def plain(column: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


class Memo(dict):
    """A dictionary that forgets everything at ``limit`` entries, so that a worker's memory stays bounded."""

    def __init__(self, limit: int, make=None):
        super().__init__()
        self.limit, self.make = limit, make

    def __missing__(self, key):
        if self.make is None:
            raise KeyError(key)
        return self.make(key)

    def room(self) -> None:
        if len(self) >= self.limit:
            self.clear()


def lines_with_words(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip(SPACE)]


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; number signs such as ½ or Ⅷ are not."""
    return any(map(str.isalpha, text))
