"""String functions over code points, with null for what isn't there.

Built-in expressions wherever they can say it; Arrow-batched functions for Unicode
normalisation, one-pass replacement of many literals and full JSON paths.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_SPACE = " \t\n\x0b\x0c\r"


def quote(literal: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", literal)


def titlecase(c: Column) -> Column:
    """A word starts after anything that isn't a letter."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\p{L}[\p{L}\p{M}]*|[^\p{L}]+)"), F.lit(0))
    return F.when(c.isNotNull(), F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), ""))


def strip_chars(c: Column, chars: str | None = None, side: str = "both") -> Column:
    f = {"both": F.trim, "start": F.ltrim, "end": F.rtrim}[side]
    return f(c, F.lit(ASCII_SPACE if chars is None else chars))


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def strip_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), F.left(c, F.char_length(c) - len(suffix))).otherwise(c)


def contains(c: Column, pattern: str, literal: bool = False) -> Column:
    return F.contains(c, F.lit(pattern)) if literal else F.rlike(c, F.lit(pattern))


def like(c: Column, pattern: str) -> Column:
    """SQL LIKE without an escape character."""
    return c.like(pattern.replace("\\", "\\\\"))


def contains_any(c: Column, patterns: list[str], ascii_case_insensitive: bool = False) -> Column:
    if not patterns:
        return F.when(c.isNotNull(), F.lit(False))
    return F.rlike(c, F.lit(("(?i)" if ascii_case_insensitive else "") + "|".join(map(quote, patterns))))


def find(c: Column, pattern: str, literal: bool = False) -> Column:
    """Byte offset of the first match; null without one."""
    at = F.instr(c, pattern) if literal else F.regexp_instr(c, F.lit(pattern))
    return F.when(at > 0, F.octet_length(F.left(c, at - 1)))


def count_matches(c: Column, pattern: str, literal: bool = False) -> Column:
    return F.regexp_count(c, F.lit(quote(pattern) if literal else pattern)).cast("bigint")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


def extract_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def extract_groups(c: Column, pattern: str) -> Column:
    """A struct of the captures, named by their names or numbers; null fields without a match."""
    compiled = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    names = {v: k for k, v in compiled.groupindex.items()}
    return F.struct(*[F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, k)).alias(names.get(k, str(k))) for k in range(1, compiled.groups + 1)])


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\$1")


def _java_replacement(value: str) -> str:
    return re.sub(r"\$\{(\d+)\}", r"$\1", value)


def replace_all(c: Column, pattern: str, value: str, literal: bool = False) -> Column:
    return F.replace(c, F.lit(pattern), F.lit(value)) if literal else F.regexp_replace(c, pattern, _java_replacement(value))


def replace_first(c: Column, pattern: str, value: str, literal: bool = False) -> Column:
    """The first match only: what comes before and after it stays."""
    p = quote(pattern) if literal else pattern
    v = value.replace("\\", "\\\\").replace("$", "\\$") if literal else _java_replacement(value)
    shifted = v if literal else re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}" if m[1] != "0" else "$0", v)
    return F.when(F.rlike(c, F.lit(p)), F.regexp_replace(c, rf"(?s)\A(.*?)(?:{p})", "$1" + shifted)).otherwise(c)


def slice_chars(c: Column, offset: int, length: int | None = None) -> Column:
    """Code points from ``offset``; a negative one counts from the end, and the part before the start is clipped."""
    n = F.char_length(c)
    start = F.lit(offset) if offset >= 0 else F.greatest(n + offset, F.lit(0))
    stop = n if length is None else (F.lit(offset) if offset >= 0 else n + offset) + length
    return F.substr(c, start + 1, F.greatest(stop - start, F.lit(0)))


def head(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n)) if n >= 0 else F.left(c, F.greatest(F.char_length(c) + n, F.lit(0)))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n)) if n >= 0 else F.right(c, F.greatest(F.char_length(c) + n, F.lit(0)))


def pad(c: Column, width: int, fill: str, start: bool) -> Column:
    """Never cuts."""
    return F.when(F.char_length(c) >= width, c).otherwise((F.lpad if start else F.rpad)(c, width, fill))


def zfill(c: Column, width: int) -> Column:
    signed = F.rlike(c, F.lit(r"^[+-]"))
    return F.when(F.char_length(c) >= width, c).when(signed, F.concat(F.left(c, F.lit(1)), F.lpad(F.substr(c, F.lit(2)), width - 1, "0"))).otherwise(F.lpad(c, width, "0"))


def split(c: Column, by: str, literal: bool = True, inclusive: bool = False) -> Column:
    p = quote(by) if literal else by
    parts = F.split(c, rf"(?<={p})" if inclusive else p, -1)
    if inclusive:  # nothing follows a separator at the end
        parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return parts


def split_fields(c: Column, by: str, n: int, keep_rest: bool) -> Column:
    """A struct field_0 ..: ``n`` splits more than fields, or the rest in the last field."""
    count = n if keep_rest else n + 1
    parts = F.split(c, quote(by), n if keep_rest else -1)
    return F.struct(*[F.get(parts, F.lit(k)).alias(f"field_{k}") for k in range(count)])


def encode(c: Column, how: str) -> Column:
    data = c.cast("binary")
    return F.lower(F.hex(data)) if how == "hex" else F.regexp_replace(F.base64(data), r"\s", "")


def decode(c: Column, how: str, strict: bool = True) -> Column:
    if strict:
        return F.to_binary(c, F.lit(how))
    return F.try_to_binary(c, F.lit(how))


def to_integer(c: Column, base: int = 10, strict: bool = True) -> Column:
    """Base 2 to 36, with a sign; what isn't one is null or raises."""
    digits = "".join("0123456789abcdefghijklmnopqrstuvwxyz"[:base])
    ok = F.rlike(F.lower(c), F.lit(rf"^[+-]?[{digits}]+$"))
    value = F.conv(F.regexp_replace(c, r"^[+-]", ""), base, 10).try_cast("decimal(20,0)")
    signed = F.when(F.startswith(c, F.lit("-")), -value).otherwise(value).try_cast("bigint")
    bad = F.raise_error(F.concat(F.lit("not an integer: "), c)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(c.isNull(), F.lit(None).cast("bigint")).when(ok, F.coalesce(signed, bad)).otherwise(bad)


def json_decode(c: Column, schema: T.DataType | str) -> Column:
    return F.from_json(c, schema, {"mode": "FAILFAST"})


def concat_columns(columns: list[Column], separator: str = "", ignore_nulls: bool = False) -> Column:
    texts = [c.cast("string") for c in columns]
    if ignore_nulls:
        return F.concat_ws(separator, *texts)
    parts = [x for k, t in enumerate(texts) for x in ([F.lit(separator)] if k else []) + [t]]
    return F.concat(*parts)


def normalize(c: Column, form: str = "NFC") -> Column:
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"no form {form!r}")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(form, x), na_action="ignore")

    # Texts of ASCII are normal in every form and stay in the JVM's batch.
    return F.when(F.rlike(c, F.lit(r"\A\p{ASCII}*\z")), c).otherwise(run(c))


def replace_many(c: Column, patterns: list[str], values: list[str], leftmost: bool = False, ascii_case_insensitive: bool = False) -> Column:
    """All literals in one pass; of those that match at a place the first one listed, or the longest with ``leftmost``."""
    order = sorted(range(len(patterns)), key=lambda k: -len(patterns[k])) if leftmost else range(len(patterns))
    found = re.compile("|".join(re.escape(patterns[k]) for k in order), re.I if ascii_case_insensitive else 0)
    table = {}
    for p, v in zip(patterns, values, strict=True):
        table.setdefault(p.lower() if ascii_case_insensitive else p, v)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        get = (lambda m: table[m[0].lower()]) if ascii_case_insensitive else (lambda m: table[m[0]])
        return s.map(lambda x: found.sub(get, x), na_action="ignore")

    return run(c) if patterns else c


_STEP = re.compile(r"\.\.(\*|[A-Za-z_][\w-]*)|\.(\*|[A-Za-z_][\w-]*)|\[(\*|-?\d*:-?\d*(?::-?\d+)?|-?\d+|'[^']*'|\"[^\"]*\"|\?\(.*?\))\]")
_FILTER = re.compile(r"\?\(\s*@\.([\w-]+)\s*(?:(==|!=|<=|>=|<|>)\s*(.+?))?\s*\)")


def json_path(value: object, path: str) -> list:
    """Every value that a JSON path selects, in document order."""
    import json

    found, at = [value], 1
    if not path.startswith("$"):
        raise ValueError(f"not a JSON path: {path!r}")

    def deep(x: object) -> list:
        inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        return [x, *[z for y in inner for z in deep(y)]]

    def passes(x: object, test: re.Match) -> bool:
        if not isinstance(x, dict) or test[1] not in x:
            return False
        if test[2] is None:
            return True
        a, text = x[test[1]], test[3]
        b = text[1:-1] if text[:1] in "'\"" else json.loads(text)
        try:
            return {"==": a == b, "!=": a != b}[test[2]] if test[2] in ("==", "!=") else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[test[2]]
        except TypeError:
            return False

    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"not a JSON path: {path!r}")
        at = m.end()
        name, inside = m[1] or m[2], m[3]
        pool = [y for x in found for y in deep(x)] if m[1] else found
        if inside and inside[0] in "'\"":
            name, inside = inside[1:-1], None
        out = []
        for x in pool:
            if name == "*" or inside == "*":
                out += list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
            elif name is not None:
                if isinstance(x, dict) and name in x:
                    out.append(x[name])
            elif inside.startswith("?"):
                test = _FILTER.fullmatch(inside)
                items = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
                out += [y for y in items if test and passes(y, test)]
            elif isinstance(x, list):
                if ":" in inside:
                    out += x[slice(*[int(p) if p else None for p in inside.split(":")])]
                elif -len(x) <= int(inside) < len(x):
                    out.append(x[int(inside)])
        found = out
    return found


def json_path_match(c: Column, path: str) -> Column:
    """The first match as text; null without one. Plain paths stay built in."""
    import json

    if re.fullmatch(r"\$(\.[A-Za-z_]\w*|\[\d+\])*", path):
        return F.get_json_object(c, path)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str) -> str | None:
            try:
                got = json_path(json.loads(x), path)
            except ValueError:
                return None
            v = got[0] if got else None
            return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)

        return s.map(one, na_action="ignore")

    return run(c)
