"""Column expressions over post records."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbside.functions.text import capture, strip


def text_fallback(full_text: Column) -> Column:
    """The first five lines of more than ten characters."""
    lines = F.filter(
        F.transform(F.split(full_text, "\n"), strip), lambda line: F.length(line) > 10
    )
    return F.array_join(F.slice(lines, 1, 5), "\n")


def reaction_count(label: Column) -> Column:
    """First run of digits and commas as a number; 0 without one. Null marks
    a run of commas only: such a post is unreadable and goes to the rejects."""
    run = capture(label, r"([\d,]+)")
    return F.when(run.isNull(), F.lit(0).cast("bigint")).otherwise(
        F.replace(run, F.lit(","), F.lit("")).try_cast("bigint")
    )


def comment_count(label: Column) -> Column:
    return F.coalesce(capture(label, r"(\d+)").try_cast("bigint"), F.lit(0).cast("bigint"))


def post_id(url: Column, author: Column, text: Column) -> Column:
    """A stable id: the link, else author and opening text, else the record."""
    author, text = F.coalesce(author, F.lit("")), F.coalesce(text, F.lit(""))
    opening = F.concat(author, F.lit("_"), F.sha2(F.substring(text, 1, 100), 256))
    record = F.concat(
        F.lit("post_"), F.sha2(F.concat(author, F.lit("\x1f"), text), 256)
    )
    return (
        F.when(F.coalesce(url, F.lit("")) != "", url)
        .when((author != "") & (text != ""), opening)
        .otherwise(record)
    )
