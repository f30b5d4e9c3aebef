"""Scalar column functions: parsing, normalising, hashing, JSON and small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths at which source text is cut for keys, event rows, snippets and sequence rows.
CLIP = {"dedupe": 400, "event": 500, "snippet": 1500, "sequence": 300}


def blank(x: Column) -> Column:
    """null as the empty string."""
    return F.coalesce(x, F.lit(""))


def unblank(x: Column) -> Column:
    """The empty string as null."""
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without Unicode white space at either end; trim() only takes spaces."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Lower case, runs of white space as one space, stripped."""
    return strip(F.regexp_replace(F.lower(blank(x)), r"(?U)\s+", " "))


def safe_int(x: Column, default: int | None = 0) -> Column:
    return F.coalesce(strip(x.cast("string")).try_cast("int"), F.lit(default).cast("int"))


def safe_double(x: Column) -> Column:
    return strip(x.cast("string")).try_cast("double")


def as_bool(x: Column) -> Column:
    """true for true, 1 and yes in any case, else false, null included."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def bool_text(x: Column) -> Column:
    return F.when(as_bool(x), "true").otherwise("false")


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole; null where whole is missing or not positive."""
    out = F.when(whole > 0, part.cast("double") / whole.cast("double"))
    return out if digits is None else F.bround(out, digits)


def clip(x: Column, kind: str) -> Column:
    """The first code points of a text, as many as the kind allows."""
    return F.substring(blank(x), 1, CLIP[kind])


def stable_id(*parts: Column, length: int = 32) -> Column:
    """Leading hex digits of the SHA-256 of the parts joined by |; arrays are joined by >."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of a JSON object of the columns, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def seed_offset(key: Column, modulus: int = 1000) -> Column:
    """A stable number below modulus from the first twelve hex digits of a key's SHA-256."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long") % modulus).cast("int")


def action_signature(category: Column, name: Column) -> Column:
    """category|name, normalised."""
    return F.concat_ws("|", squeeze(category), squeeze(name))


def json_signature(signature: Column, parts: list[str], otherwise: Column) -> Column:
    """The named fields of a signature of version 2 or later, joined by |; else `otherwise`."""
    version = F.get_json_object(signature, "$.v").try_cast("int")
    fields = F.array(*(blank(F.get_json_object(signature, f"$.{p}")) for p in parts))
    return F.when(version >= 2, F.array_join(fields, "|")).otherwise(otherwise)


def starts_with_path(path: Column, prefix: Column) -> Column:
    """Whether an array starts with all elements of another."""
    return F.slice(path, 1, F.size(prefix)) == prefix


def identifier_words(x: Column) -> Column:
    """The words of a camelCase or snake_case identifier, lower-cased."""
    return F.transform(F.regexp_extract_all(blank(x), F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), lambda w: F.lower(w))


def humanize(x: Column) -> Column:
    return F.array_join(identifier_words(x), " ")


def string_literals(x: Column) -> Column:
    """Contents of quoted literals without line breaks."""
    return F.transform(
        F.regexp_extract_all(blank(x), F.lit(r"""'[^'\n]*'|"[^"\n]*"|`[^`\n]*`"""), F.lit(0)),
        lambda s: F.substring(s, F.lit(2), F.length(s) - 2),
    )


def mask_literals(x: Column, mask: str = "''") -> Column:
    return F.regexp_replace(blank(x), r"""'[^'\n]*'|"[^"\n]*"|`[^`\n]*`""", mask)


def call_names(x: Column) -> Column:
    """Dotted names in front of an opening parenthesis."""
    return F.regexp_extract_all(blank(x), F.lit(r"([A-Za-z_$][A-Za-z0-9_$.]*)\s*\("), F.lit(1))


def redact(x: Column) -> Column:
    """Mail addresses and digit runs of six or more, masked."""
    out = F.regexp_replace(blank(x), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<email>")
    return F.regexp_replace(out, r"[0-9]{6,}", "<number>")


def static_urls(x: Column) -> Column:
    """Distinct absolute or root-relative URLs that stand in quotes."""
    return F.array_distinct(F.regexp_extract_all(blank(x), F.lit(r"""['"`]((?:https?://|/)[^'"`\s$]*)['"`]"""), F.lit(1)))


def has_dynamic_url(x: Column) -> Column:
    """Whether a URL is built: a template substitution or a concatenation after a quoted path."""
    return blank(x).rlike(r"`[^`]*\$\{[^`]*`") | blank(x).rlike(r"""['"](?:https?://|/)[^'"]*['"]\s*\+""")


def provenance_parts(x: Column) -> Column:
    """kind:path#field as a struct; missing parts are null."""
    return F.struct(
        unblank(F.regexp_extract(blank(x), r"^([a-z_]+):", 1)).alias("kind"),
        unblank(F.regexp_extract(blank(x), r"^(?:[a-z_]+:)?([^#]*)", 1)).alias("path"),
        unblank(F.regexp_extract(blank(x), r"#(.*)$", 1)).alias("field"),
    )


def framework(x: Column) -> Column:
    """The framework a label names, or Unknown."""
    low, out = F.lower(blank(x)), F.lit("Unknown")
    for name in ("Nightwatch", "Puppeteer", "WebDriverIO", "TestCafe", "Cypress", "Playwright"):
        out = F.when(low.contains(name.lower()), name).otherwise(out)
    return out


def path_class(x: Column) -> Column:
    """test, build or production, by a file's path."""
    low = F.lower(blank(x))
    return (
        F.when(low.rlike(r"(^|/)(__tests__|tests?|e2e|specs?|cypress)/|\.(spec|test|cy)\.[a-z]+$"), "test")
        .when(low.rlike(r"(^|/)(dist|build|out|node_modules|coverage)/|(^|/)(package(-lock)?\.json|yarn\.lock|[a-z.]*config\.[a-z]+)$"), "build")
        .otherwise("production")
    )


def safe_directory(x: Column) -> Column:
    """A repository's name as one folder name."""
    return F.replace(blank(x), F.lit("/"), F.lit("__"))


def mixed_radix(index: Column, sizes: list[Column]) -> list[Column]:
    """Digits of an index in a mixed radix, the first the slowest."""
    out, scale = [], F.lit(1).cast("long")
    for size in reversed(sizes):
        out.append((F.floor(index / scale) % size).cast("int"))
        scale = scale * size
    return out[::-1]


def merge_counts(a: Column, b: Column) -> Column:
    """Sum of two label-count maps; null counts as empty."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def most_common(counts: Column) -> Column:
    """The label with the highest count, ties by label."""
    entries = F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label")))
    return F.get(F.array_sort(entries), 0)["label"]


def mismatch_tags(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the pairs whose two values differ, joined by ;, or `match`."""
    tags = F.array_compact(F.array(*(F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items())))
    return F.when(F.size(tags) > 0, F.array_join(tags, ";")).otherwise("match")
