"""Scalar functions: hashes, labels, keys, templates."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridtally.operators.sets import canonical_json


def fnv1a_32(text: Column) -> Column:
    """FNV-1a with 32 bits over the low byte of each character, as 8 hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    start = F.lit(0x811C9DC5).cast("long")
    hashed = F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c.bitwiseAND(F.lit(255).cast("long"))) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lpad(F.lower(F.hex(hashed)), 8, "0")


def interval_label(chrom: Column, start: Column, end: Column) -> Column:
    """chrom:1_000-2_000, or the chromosome, or 'whole-genome'."""
    shown = lambda x: F.translate(F.format_number(x, 0), ",", "_")
    span = F.concat(chrom, F.lit(":"), shown(start), F.lit("-"), shown(end))
    return F.coalesce(F.when(start.isNotNull() & end.isNotNull(), span), chrom, F.lit("whole-genome"))


def first_line(text: Column, most: int = 200) -> Column:
    return F.left(F.substring_index(text, "\n", 1), F.lit(most))


def iso_utc(epoch_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def object_key(value, digits: int = 32) -> str:
    """The sha256 of canonical JSON, cut to digits."""
    return hashlib.sha256(canonical_json(value).encode("utf-8")).hexdigest()[:digits]


def canonical_groups(groups: dict[str, list[str]]) -> dict[str, list[str]]:
    return {name: sorted(groups[name]) for name in sorted(groups)}


def cache_key(template: str, args: dict, fields: list[str] | None = None) -> str:
    """A key that doesn't depend on the order of arguments or of fields; no fields is not a filter."""
    key = f"{template}?{canonical_json(args)}"
    return f"{key}#fields={','.join(sorted(fields))}" if fields else key


def ld_key(request: dict, engine: str) -> str:
    """The key of a linkage request: neither how its triangles are assigned nor its threads count, nor the order of samples."""
    body = {k: request.get(k) for k in ("chrom", "window_range", "shelf_bp", "snp_cap", "thin_to")} | {"groups": canonical_groups(request["groups"]), "engine": engine}
    plain = json.dumps(body, sort_keys=True, separators=(",", ":"))  # non-ASCII escaped, unlike elsewhere: fixed by the format
    return "fast_ld.split." + hashlib.sha256(plain.encode("utf-8")).hexdigest()[:24]


def fill_template(template: str, *scopes: dict) -> str:
    """{slot} from the first scope that has it; an unknown slot raises KeyError."""

    def value(m: re.Match) -> str:
        for scope in scopes:
            if m[1] in scope:
                return str(scope[m[1]])
        raise KeyError(m[1])

    return re.sub(r"\{(\w+)\}", value, template)


def interpolate(values: dict[str, str], most: int = 10) -> dict[str, str]:
    """${name} replaced in all values until nothing changes; a cycle raises ValueError."""
    out = dict(values)
    for _ in range(most):
        new = {k: re.sub(r"\$\{(\w+)\}", lambda m: out.get(m[1], m[0]), v) for k, v in out.items()}
        if new == out:
            return out
        out = new
    raise ValueError("the values refer to each other in a cycle")


def parse_scale(spec: str, named: dict[str, tuple[int, int]]) -> tuple[str, int, int]:
    """(label, win, step) from 'label:win:step' or a known name."""
    parts = spec.split(":")
    if len(parts) == 3 and parts[1].isdigit() and parts[2].isdigit() and int(parts[1]) > 0 and int(parts[2]) > 0:
        return parts[0], int(parts[1]), int(parts[2])
    if spec in named:
        return (spec, *named[spec])
    raise ValueError(f"no such scale: {spec}")
