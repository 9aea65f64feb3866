"""String and number parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits order by value: each run is left-padded to twenty places."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 20, "0")).otherwise(p)), "")


def slug(text: Column, fallback: str = "project") -> Column:
    """A file-name-safe form; the fallback where nothing but dots is left."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[/\\]", "-")
    t = F.regexp_replace(t, r'[<>:"|?*\x00-\x1F]|\s+|\.\.', "_")
    t = F.regexp_replace(t, "^_+|_+$", "")
    return F.when(t.rlike(r"^\.*$"), F.lit(fallback)).otherwise(t)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))


def parse_number(text: Column) -> Column:
    """A decimal number or a simple fraction; null for anything else, and for a zero denominator."""
    t = F.trim(text)
    top, bottom = (F.regexp_extract(t, r"^(\d+)\s*/\s*(\d+)$", i).try_cast("double") for i in (1, 2))
    return F.when(t.rlike(r"^\d+\s*/\s*\d+$"), F.when(bottom != 0, top / bottom)).when(t != "", t.try_cast("double"))


def binding_key(key: Column) -> Column:
    """Struct (profile, animation, frame) of ``profile/animation:frame``; null fields where the form differs."""
    part = lambda i: F.regexp_extract(key, r"^([^/]+)/(.+):(\d+)$", i)
    ok = key.rlike(r"^[^/]+/.+:\d+$")
    return F.struct(F.when(ok, part(1)).alias("profile"), F.when(ok, part(2)).alias("animation"), F.when(ok, part(3).try_cast("int")).alias("frame"))


def parse_flag(text: Column, fallback: Column | bool = False) -> Column:
    """1, true, yes or 0, false, no, in any case; the fallback for anything else, and for none."""
    t = F.lower(F.trim(text))
    other = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False).otherwise(other)


def parse_point(text: Column) -> Column:
    """Struct (x, y) of ``x,y``, ``[x, y]`` or an object with x and y, which may stand under ``group``; null otherwise."""
    number = r"(-?\d+(?:\.\d+)?)"
    plain, listed = rf"^\s*{number}\s*,\s*{number}\s*$", rf"^\s*\[\s*{number}\s*,\s*{number}\s*[\],]"
    at = lambda p, i: F.regexp_extract(text, p, i).try_cast("double")
    field = lambda c: F.coalesce(F.get_json_object(text, f"$.group.{c}"), F.get_json_object(text, f"$.{c}")).try_cast("double")
    space = F.coalesce(F.get_json_object(text, "$.space"), F.lit("group")).isin("group", "")
    x, y = (F.when(text.rlike(plain), at(plain, i)).when(text.rlike(listed), at(listed, i)).when(text.rlike(r"^\s*\{") & space, field(c)) for i, c in ((1, "x"), (2, "y")))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def parse_divisions(text: Column) -> Column:
    """Struct (x, y) of ``8x6`` or one number for both, each from 2 to 64; null otherwise."""
    t = F.lower(F.trim(text))
    both = r"^(\d+)(?:\s*[x×*]\s*(\d+))?$"
    x = F.regexp_extract(t, both, 1).try_cast("int")
    y = F.coalesce(F.regexp_extract(t, both, 2).try_cast("int"), x)
    return F.when(x.between(2, 64) & y.between(2, 64), F.struct(x.alias("x"), y.alias("y")))


def iso_stamp(at: Column) -> Column:
    """A time as text in UTC, to the millisecond."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
