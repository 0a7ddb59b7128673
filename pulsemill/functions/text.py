"""Labels, tokens, keys and display strings."""

from itertools import chain

from pyspark.sql import Column, functions as F

from pulsemill.functions import fixed
from pulsemill.functions.numeric import _col, finite_or_null, is_finite


def _lookup(token: Column, table: dict) -> Column:
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(pairs, token)


def normalize_token(c) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(_col(c), r"[^\p{L}\p{N}]", ""))


def canonical_split(c) -> Column:
    """train / val / test, or NULL for a label outside the alias set."""
    return _lookup(normalize_token(c), fixed.SPLIT_ALIASES)


def canonical_source(c) -> Column:
    """Known source name, else the trimmed lower-case text; NULL when blank."""
    text = F.trim(_col(c))
    known = _lookup(normalize_token(c), fixed.SOURCE_ALIASES)
    return F.when(F.length(text) > 0, F.coalesce(known, F.lower(text)))


def resolve_column(columns, aliases: list) -> Column:
    """Name in `columns` that matches the first matching alias; later duplicates win."""
    def last_match(alias):
        return F.try_element_at(
            F.filter(_col(columns), lambda c: normalize_token(c) == normalize_token(F.lit(alias))),
            F.lit(-1))
    return F.coalesce(*[last_match(a) for a in aliases])


def safe_token(c) -> Column:
    body = F.regexp_replace(F.trim(_col(c).cast("string")), r"[^\p{L}\p{N}]", "_")
    stripped = F.regexp_replace(body, "^_+|_+$", "")
    return F.when(stripped == "", F.lit("record")).otherwise(stripped)


def window_id(split, n) -> Column:
    """`{split}_{n}` with the number padded to eight digits."""
    digits = _col(n).cast("string")
    return F.concat(_col(split), F.lit("_"),
                    F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))


def case_key(split, n, subject_id, record_id) -> Column:
    return F.concat_ws("_", window_id(split, n), safe_token(subject_id), safe_token(record_id))


def window_key(fields: dict) -> Column:
    """`name=value` pairs joined by `|`; a missing value prints as `nan`."""
    parts = [
        F.concat(F.lit(name + "="), F.coalesce(_col(c).cast("string"), F.lit("nan")))
        for name, c in fields.items()
    ]
    return F.concat_ws("|", *parts)


def _number(c, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", finite_or_null(c))


def format_ci(mean, low, high, digits: int = 2) -> Column:
    ok = is_finite(mean) & is_finite(low) & is_finite(high)
    text = F.concat(_number(mean, digits), F.lit(" ["), _number(low, digits),
                    F.lit(", "), _number(high, digits), F.lit("]"))
    return F.when(ok, text).otherwise(F.lit(""))


def format_mean_sd(mean, sd, digits: int = 2) -> Column:
    ok = is_finite(mean) & is_finite(sd)
    text = F.concat(_number(mean, digits), F.lit(" +/- "), _number(sd, digits))
    return F.when(ok, text).otherwise(F.lit(""))
