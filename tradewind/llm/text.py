"""Words, and helpers that several operators share."""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
# In Python, `bytes.split()` cuts at exactly these six.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The words of a text in order, an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(docs: DataFrame, produced: list[str]) -> Column:
    """All columns of `docs` as one struct `_row`, but those an operator replaces by its own.

    With the rest of the row out of the way, extra columns cannot clash with an operator's names.
    """
    taken = {name.lower() for name in produced}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    return F.struct(*kept).alias("_row")


def row_key(docs: DataFrame) -> Column:
    """Hash of a whole row; with the doc_id it tells all rows apart that are not copies of each other."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose lengths add up to `most` or less, or that are one item.

    Arrow batches are bounded in rows, not bytes; this bounds what is worked on at a time.
    """
    start = total = 0
    for i, length in enumerate(lengths):
        if i > start and total + length > most:
            yield start, i
            start, total = i, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths)
