"""Native text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (keeps the expression tree small)."""
    return F.transform(F.array(value), body)[0]


def _from(text: Column, position: Column) -> Column:
    """The text from a 1-based position to its end."""
    return F.substr(text, position)


def _shortest_java_form(ax: Column) -> Column:
    """Java-style text (``d.dddE<exp>``) of the shortest '%.Ne' rendering that reads back as ax."""
    shortest = F.coalesce(
        *[F.when(F.format_string(f"%.{p}e", ax).cast("double") == ax, F.format_string(f"%.{p}e", ax))
          for p in (0, 13, 14, 15, 16)],
        F.format_string("%.16e", ax),
    )
    return _let(shortest, lambda sh: F.concat(
        F.regexp_replace(F.substring_index(sh, "e", 1), r"\.?0*$", ""),
        F.lit("E"), F.substring_index(sh, "e", -1).cast("int").cast("string"),
    ))


def _layout(body: Column) -> Column:
    """Python layout of a positive Java-form number text (plain, or mantissa 'E' exponent)."""
    def with_parts(digits, exp):
        sci = F.concat(
            F.substring(digits, 1, 1),
            F.when(F.length(digits) > 1, F.concat(F.lit("."), _from(digits, F.lit(2)))).otherwise(F.lit("")),
            F.lit("e"),
            F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")),
            F.when(F.abs(exp) >= 100, F.abs(exp).cast("string")).otherwise(F.lpad(F.abs(exp).cast("string"), 2, "0")),
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
        frac = _from(digits, exp + 2)
        large = F.concat(F.rpad(digits, exp + 1, "0"), F.lit("."), F.when(frac == "", F.lit("0")).otherwise(frac))
        return F.when((exp < -4) | (exp >= 16), sci).when(exp < 0, small).otherwise(large)

    raw_digits = F.regexp_replace(F.regexp_replace(F.substring_index(body, "E", 1), r"\.", ""), "0+$", "")
    digits = F.when(raw_digits == "", F.lit("0")).otherwise(raw_digits)
    exp = F.substring_index(body, "E", -1).cast("int")
    return F.when(F.instr(body, "E") == 0, body).otherwise(
        _let(digits, lambda d: _let(exp, lambda e: with_parts(d, e)))
    )


def python_float_text(x: Column) -> Column:
    """Render a double the way Python's ``repr``/``str.format('{}')`` does.

    Spark's cast gives Java's form (``3.4E-4``, ``1.0E-5``); Python switches to exponent form
    only below 1e-4 or from 1e16 on and writes ``3.4e-05``. Both use the shortest digits that
    round-trip, so the layout is rewritten. Java 17 sometimes prints one digit too many (from
    about 1e16, and for subnormals); those values take the shortest '%.Ne' text that reads
    back as the same double.
    """
    def render(v):
        ax = F.abs(v)
        java = F.regexp_replace(v.cast("string"), "^-", "")
        sig = F.length(F.regexp_replace(F.regexp_replace(F.substring_index(java, "E", 1), r"\.", ""), "^0+|0+$", ""))
        suspicious = ((sig >= 17) | ((ax < F.lit(2.2250738585072014e-308)) & (v != 0))) & ~F.isnan(v) & (
            ax != F.lit(float("inf")))
        body = F.when(suspicious, _shortest_java_form(ax)).otherwise(java)
        special = (
            F.when(F.isnan(v), F.lit("nan"))
            .when(v == F.lit(float("inf")), F.lit("inf"))
            .when(v == F.lit(float("-inf")), F.lit("-inf"))
        )
        sign = F.when(F.startswith(v.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
        return F.coalesce(special, F.concat(sign, _let(body, _layout)))

    return F.when(x.isNotNull(), _let(x.cast("double"), render))
