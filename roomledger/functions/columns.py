"""Column expressions used by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomledger import schema


def exact_mean(total: Column, n: Column) -> Column:
    """Mean as one double division, so that decimal totals lose nothing on the way."""
    return F.try_divide(total.cast("double"), n.cast("double"))


def whole_number(value: Column, name: str) -> Column:
    """A 32-bit integer; a value that is none stops the job instead of being cut."""
    number = value.try_cast("int")
    message = F.concat(F.lit(f"{name} holds a value that is no 32-bit whole number: "), value.cast("string"))
    exact = number.cast("double") == value.cast("double")
    return F.when(value.isNull() | exact, number).otherwise(F.raise_error(message).cast("int"))


def bin_label(
    value: Column,
    edges: Sequence[float] = schema.LEAD_TIME_EDGES,
    labels: Sequence[str] = schema.LEAD_TIME_LABELS,
) -> Column:
    """Label of the bin (edge, next edge] that holds the value; NULL below the first edge."""
    label = F.lit(None).cast("string")
    for edge, text in zip(edges, labels):
        label = F.when(value > edge, F.lit(text)).otherwise(label)
    return label


def calendar_date(year: Column, month_name: Column, day: Column) -> Column:
    """Date from year, English month name and day of month; NULL if there is no such day.

    Built from numbers: parsing text costs several times as much per row. Years outside
    ``schema.YEARS`` have no such day.
    """
    month = F.nullif(F.array_position(F.lit(list(schema.MONTH_NAMES)), F.lower(month_name)), F.lit(0)).cast("int")
    first = F.when(year.between(*schema.YEARS), F.make_date(year, month, F.lit(1)))
    return F.when(day.between(1, F.day(F.last_day(first))), F.date_add(first, day - 1))


def strict_date(text: Column, form: str = schema.DATE_FORMAT) -> Column:
    """Date from text of exactly the given format; anything else stops the job in any ANSI setting."""
    text = text.cast("string")
    message = F.concat(F.lit(f"not a {form} date: "), text)
    parsed = F.try_to_timestamp(text, F.lit(form)).cast("date")
    whole = F.date_format(parsed, form) == text
    return F.when(whole, parsed).otherwise(F.when(text.isNotNull(), F.raise_error(message).cast("date")))


def two_decimals(value: Column) -> Column:
    """Text with two decimals, rounded from the exact binary value; a missing value reads ``nan``."""
    number = value.cast("double")
    infinite = number.isin(float("inf"), float("-inf"))
    return (
        F.when(number.isNull() | F.isnan(number), F.lit("nan"))
        .when(infinite, F.when(number > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(F.call_function("format_number", number, F.lit("0.00")))
    )


def month_end_label(month: Column) -> Column:
    return F.date_format(F.last_day(month), "yyyy-MM-dd 00:00:00")


def base64_text(content: Column) -> Column:
    """Base64 in one line, whatever line length the session is set to."""
    return F.translate(F.base64(content), "\r\n", "")


def strip(text: Column) -> Column:
    """Remove white space of any kind, as Unicode defines it, from both ends."""
    space = schema.WHITE_SPACE
    return F.regexp_replace(F.regexp_replace(text, f"^{space}+", ""), f"{space}+$", "")


def insight_value_text(category: Column, subkey: Column, value: Column) -> Column:
    """An insight's value as text: money, percentage or plain number, chosen by its category."""
    number = two_decimals(value)
    money = F.when(subkey.isNull(), category.contains("revenue")).otherwise(
        category.isin(*schema.MONEY_CATEGORIES)
    )
    percentage = category.contains("rate") | category.contains("percentage")
    return (
        F.when(money, F.concat(F.lit("$"), number))
        .when(percentage, F.concat(number, F.lit("%")))
        .otherwise(number)
    )


def bold_amounts(text: Column) -> Column:
    """Set percentages in bold, then dollar amounts (up to the first thousands comma)."""
    percentages = F.regexp_replace(text, schema.PERCENTAGE_PATTERN, r"**$1%**")
    return F.regexp_replace(percentages, schema.DOLLAR_PATTERN, r"**\$$1**")


def bold_names(text: Column, names: Sequence[str]) -> Column:
    """Set every occurrence of each name in bold, one name after the other."""
    return reduce(lambda out, name: F.replace(out, F.lit(name), F.lit(f"**{name}**")), names, text)


def fill_template(template: str, **values: Column) -> Column:
    """Put columns in place of ``{name}`` marks; inserted text is never searched for marks."""
    pieces: list[str | Column] = [template]
    for name, value in values.items():
        mark, split = "{" + name + "}", []
        for piece in pieces:
            if isinstance(piece, str):
                first, *others = piece.split(mark)
                split.append(first)
                for other in others:
                    split += [value, other]
            else:
                split.append(piece)
        pieces = split
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces if not isinstance(p, str) or p])
