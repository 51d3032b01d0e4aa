"""Small column expressions shared by the operators (all stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round and drop the sign of zero, so results compare across engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero (ANSI mode raises on x/0)."""
    return F.try_divide(a, b)


def norm(*cols: Column | str) -> Column:
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    total = cs[0] * cs[0]
    for c in cs[1:]:
        total = total + c * c
    return F.sqrt(total)


def corr(a: Column, b: Column) -> Column:
    """Pearson correlation that is NULL on constant input instead of raising."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def distance(left: list[str], right: list[str]) -> Column:
    return norm(*[F.col(a) - F.col(b) for a, b in zip(left, right)])


def _uniform(digest: Column, start: int) -> Column:
    number = F.conv(F.substring(digest, start, 13), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(1 << 52))


def _digest(cols, seed) -> Column:
    return F.md5(F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")))


def unit_hash(*cols: Column | str, seed: int | Column = 42) -> Column:
    """Deterministic uniform in (0, 1) from a key: same value however rows are partitioned or retried."""
    return _uniform(_digest(cols, seed), 1)


def normal_hash(*cols: Column | str, seed: int | Column = 42) -> Column:
    """Deterministic standard normal draw (Box-Muller over both halves of one digest)."""
    d = _digest(cols, seed)
    return F.sqrt(-2.0 * F.ln(_uniform(d, 1))) * F.cos(2.0 * F.pi() * _uniform(d, 14))


def unit_sql(*parts: str, start: int = 1) -> str:
    """The same uniform as SQL text (last part is the seed)."""
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), {start}, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE)"


def text_order_key(c: Column | str) -> Column:
    """A number that never decreases along the byte order of a string (its first six bytes)."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.rpad(F.hex(F.encode(c, "utf-8")), 12, "0")
    return F.conv(head, 16, 10).cast("double")
