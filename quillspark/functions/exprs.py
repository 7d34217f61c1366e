"""Column-expression helpers. All are built-in Spark expressions (JVM side, whole-stage codegen);
no Python UDF is involved."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters removed by Python's str.strip() that matter for text data.
PY_WHITESPACE = " \t\n\r\x0b\x0c"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ref(name: str) -> str:
    """SQL reference to a column by name (the text helpers below are SQL expressions: building one
    costs a single parse instead of dozens of driver-to-JVM calls)."""
    if not isinstance(name, str):
        raise TypeError("pass the column name")
    return "`" + name.replace("`", "``") + "`"


# --- SQL text of the parity expressions -----------------------------------------------------
def py_strip_sql(x: str) -> str:
    chars = "".join(f"\\u{ord(ch):04X}" for ch in PY_WHITESPACE)
    return f"trim(BOTH '{chars}' FROM {x})"


def title_case_sql(x: str) -> str:
    return f"regexp_replace(initcap(regexp_replace(lower({x}), '([^\\\\p{{L}}])', '$1 ')), '([^\\\\p{{L}}]) ', '$1')"


def parse_date_sql(x: str, formats: Iterable[str]) -> str:
    return "coalesce(" + ", ".join(f"try_to_date({x}, '{f}')" for f in formats) + ")"


def money_text_sql(x: str) -> str:
    t = f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,2)) AS STRING), '0+$', '')"
    return f"(CASE WHEN {x} IS NULL THEN CAST(NULL AS STRING) WHEN endswith({t}, '.') THEN concat({t}, '0') ELSE {t} END)"


def _bind(value: str, var: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``var`` inside ``body`` (SQL has no LET)."""
    return f"element_at(transform(array({value}), {var} -> {body}), 1)"


def _py_float_layout_sql(x: str) -> str:
    s = f"CAST({x} AS STRING)"
    body = f"regexp_replace({s}, '^-', '')"
    mant = f"substring_index({body}, 'E', 1)"
    e = f"CAST(substring_index({body}, 'E', -1) AS INT)"
    raw = f"regexp_replace(regexp_replace({mant}, '[.]', ''), '0+$', '')"
    digits = f"(CASE WHEN {raw} = '' THEN '0' ELSE {raw} END)"
    n = f"length({digits})"
    positional = (f"(CASE WHEN {e} < 0 THEN concat('0.', repeat('0', -{e} - 1), {digits}) "
                  f"WHEN {n} <= {e} + 1 THEN concat({digits}, repeat('0', {e} + 1 - {n}), '.0') "
                  f"ELSE concat(substring({digits}, 1, {e} + 1), '.', substring({digits}, {e} + 2, {n})) END)")
    sci = (f"concat(CASE WHEN {n} = 1 THEN {digits} ELSE concat(substring({digits}, 1, 1), '.', substring({digits}, 2, {n})) END, "
           f"'e', CASE WHEN {e} < 0 THEN '-' ELSE '+' END, "
           f"CASE WHEN abs({e}) < 10 THEN concat('0', CAST(abs({e}) AS STRING)) ELSE CAST(abs({e}) AS STRING) END)")
    rebuilt = (f"concat(CASE WHEN startswith({s}, '-') THEN '-' ELSE '' END, "
               f"CASE WHEN {e} >= -4 AND {e} < 16 THEN {positional} ELSE {sci} END)")
    return (f"(CASE WHEN {x} IS NULL THEN CAST(NULL AS STRING) WHEN isnan({x}) THEN 'nan' "
            f"WHEN {x} = double('inf') THEN 'inf' WHEN {x} = double('-inf') THEN '-inf' "
            f"WHEN NOT contains({s}, 'E') THEN {s} ELSE {rebuilt} END)")


def py_float_text_sql(x: str) -> str:
    """SQL for Python's ``repr`` of a double: the shortest digits that read back to the same value,
    positional for 1e-4 <= |x| < 1e16, else ``d.ddde±XX``. Spark's own text (Java) supplies digits
    and exponent; Java 17 can print a digit or two more than needed, so the 15- and 16-digit
    roundings are tried first and kept when they read back to the same double."""
    # layout from (sign, significant digits, exponent of the first digit)
    layout = ("CASE WHEN ve >= -4 AND ve < 16 THEN "
              "CASE WHEN ve < 0 THEN concat('0.', repeat('0', -ve - 1), vd) "
              "WHEN length(vd) <= ve + 1 THEN concat(vd, repeat('0', ve + 1 - length(vd)), '.0') "
              "ELSE concat(substring(vd, 1, ve + 1), '.', substring(vd, ve + 2, length(vd))) END "
              "ELSE concat(CASE WHEN length(vd) = 1 THEN vd ELSE concat(substring(vd, 1, 1), '.', substring(vd, 2, length(vd))) END, "
              "'e', CASE WHEN ve < 0 THEN '-' ELSE '+' END, "
              "CASE WHEN abs(ve) < 10 THEN concat('0', CAST(abs(ve) AS STRING)) ELSE CAST(abs(ve) AS STRING) END) END")

    def rounded(k: int) -> str:
        return (f"(CAST(rpad(substring(vsig, 1, {k}), {k}, '0') AS DECIMAL(38,0)) "
                f"+ CASE WHEN substring(vsig, {k + 1}, 1) >= '5' THEN 1 ELSE 0 END)")

    def candidate(k: int, var: str) -> str:
        # struct(read-back ok, digits, exponent) of the k-digit rounding
        return _bind(rounded(k), var,
                     f"named_struct('ok', CAST(concat(CAST({var} AS STRING), 'E', CAST(ve0 - {k - 1} AS STRING)) AS DOUBLE) = vabs, "
                     f"'d', regexp_replace(CAST({var} AS STRING), '0+$', ''), "
                     f"'e', ve0 + length(CAST({var} AS STRING)) - {k})")

    choose = (f"CASE WHEN length(vsig) > 15 AND c15.ok THEN named_struct('d', c15.d, 'e', c15.e) "
              f"WHEN length(vsig) > 16 AND c16.ok THEN named_struct('d', c16.d, 'e', c16.e) "
              f"WHEN length(vsig) > 17 AND c17.ok THEN named_struct('d', c17.d, 'e', c17.e) "
              f"ELSE named_struct('d', vsig, 'e', ve0) END")
    pick = _bind(candidate(15, "r15"), "c15", _bind(candidate(16, "r16"), "c16", _bind(candidate(17, "r17"), "c17",
                 _bind(choose, "vc", _bind("vc.d", "vd", _bind("vc.e", "ve", layout))))))
    digits = ("regexp_replace(ltrim('0', concat(vip, vfp)), '0+$', '')")
    e0 = ("CASE WHEN contains(vb, 'E') THEN CAST(substring_index(vb, 'E', -1) AS INT) + length(vip) - 1 "
          "ELSE length(vip) - 1 - (length(concat(vip, vfp)) - length(ltrim('0', concat(vip, vfp)))) END")
    parts = _bind(f"substring_index(vb, 'E', 1)", "vm",
                  _bind("substring_index(vm, '.', 1)", "vip",
                        _bind("CASE WHEN contains(vm, '.') THEN substring_index(vm, '.', -1) ELSE '' END", "vfp",
                              _bind(digits, "vsig", _bind(e0, "ve0", pick)))))
    unsigned = _bind(f"regexp_replace(CAST({x} AS STRING), '^-', '')", "vb", _bind(f"abs({x})", "vabs", parts))
    sign = f"CASE WHEN startswith(CAST({x} AS STRING), '-') THEN '-' ELSE '' END"
    # Java's text with <= 15 significant digits is already the shortest: only the layout changes
    n_sig = (f"length(regexp_replace(regexp_replace(substring_index(regexp_replace(CAST({x} AS STRING), '^-', ''), "
             f"'E', 1), '[.]', ''), '^0+|0+$', ''))")
    # the common case costs no pattern: positional text of at most 15 digits is the same in both languages
    plain = f"abs({x}) >= 0.001D AND abs({x}) < 1.0E7D AND length(CAST({x} AS STRING)) <= 16"
    return (f"(CASE WHEN {plain} THEN CAST({x} AS STRING) "
            f"WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 OR {n_sig} <= 15 THEN {_py_float_layout_sql(x)} "
            f"ELSE concat({sign}, {unsigned}) END)")


def np_round(c: str | Column, n: int) -> Column:
    """numpy/pandas ``round(n)`` on doubles: ``rint(x * 10^n) / 10^n`` (half-to-even on the scaled binary value).

    Spark's ``round`` is half-up on the decimal text and differs on ties.
    """
    scale = float(10 ** n)
    return F.rint(col_(c).cast("double") * F.lit(scale)) / F.lit(scale)


def py_strip(c: str) -> Column:
    """Python ``str.strip()``: removes surrounding whitespace including tabs and newlines."""
    return F.expr(py_strip_sql(ref(c)))


def title_case(c: str) -> Column:
    """Python ``str.title()``: upper-case (title-case) the first letter of every run of letters, lower-case the rest.

    ``initcap`` alone only starts words after blanks (``johnson-davis`` -> ``Johnson-davis``). A marker
    blank is inserted after every non-letter, ``initcap`` runs, and the markers are removed again:
    three built-in string expressions, no lambda, so the projection stays in whole-stage codegen.
    """
    return F.expr(title_case_sql(ref(c)))


def parse_date(c: str, formats: Iterable[str]) -> Column:
    """First format that parses wins; unparseable text gives null (never an error under ANSI)."""
    return F.expr(parse_date_sql(ref(c), formats))


def nan_to_null(c: str | Column) -> Column:
    """pandas treats NaN as missing; Spark does not (NaN >= 0 is true). Normalise once at read."""
    x = col_(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def money_text(c: str) -> Column:
    """Text of a double the way Python prints a float that carries at most 2 decimals.

    ``str(12345678.5)`` is ``12345678.5`` in Python while Spark's cast prints ``1.23456785E7``;
    building the text from a decimal cast avoids the exponent form. Null stays null.
    """
    return F.expr(money_text_sql(ref(c)))


def row_hash(invoice_id: str, amount: str, invoice_date: str) -> Column:
    """md5 hex of ``invoice_id || amount || invoice_date`` with no separator (as the source system does).

    The amount is rendered as Python prints a float (``12345678.0``, not Java's ``1.2345678E7``);
    a missing amount renders as ``nan``. Note: without separators ``"1"+"23"`` equals ``"12"+"3"``;
    kept for parity with existing fingerprints.
    """
    return F.expr(f"md5(concat(coalesce({ref(invoice_id)}, 'None'), coalesce({py_float_text_sql(ref(amount))}, 'nan'), "
                  f"coalesce({ref(invoice_date)}, 'None')))")


def all_true(cond: Column) -> Column:
    """pandas ``(cond).all()``: null comparisons count as False, empty input is True."""
    return F.coalesce(F.bool_and(F.coalesce(cond, F.lit(False))), F.lit(True))


def rate_pct(part: str | Column, whole: str | Column, n: int = 2) -> Column:
    """``(part / whole * 100).round(n)`` as pandas computes it; a zero denominator gives null, not an error."""
    return np_round(F.try_divide(col_(part).cast("double"), col_(whole).cast("double")) * F.lit(100.0), n)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row global aggregate to every row of ``df``.

    The row is one scalar subquery (a struct, so all its columns come from one run of the aggregate): nothing
    runs while the plan is built, no join is planned, and exchanges that both sides share are reused. An
    aggregate without grouping keys always has exactly one row; more than one would raise.
    """
    row = one_row.select(F.struct(*[F.col(ref(c)) for c in one_row.columns])).scalar()
    held = "__scalars"
    while held in df.columns:
        held += "_"
    # named once: a plan that nests scalars holds one copy of the aggregate, not one per column
    return df.select("*", row.alias(held)).select("*", *[F.col(held).getField(c).alias(c) for c in one_row.columns]).drop(held)


def py_float_text(c: str) -> Column:
    """``str(x)`` of a Python float, built from Spark's own shortest digits.

    Spark (Java) switches to ``d.dddE-5`` below 1e-3 and from 1e7 up; Python prints positional
    text for 1e-4 <= |x| < 1e16 and ``d.ddde-05`` / ``d.ddde+16`` outside. The digits are the same;
    only the layout is rebuilt, and where Java 17 prints more digits than needed the shortest
    15/16/17-digit form that reads back to the same value is used. NaN and infinities print as
    ``nan`` / ``inf``. Equal to ``repr`` on random values below 1e17 (tested); from 1e17 up the
    last digit can differ where two equally short forms read back to the same value.
    """
    return F.expr(py_float_text_sql(ref(c)))
