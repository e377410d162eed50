"""Request headers, media types, errors and durations."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: HTTP status by error code.
ERROR_STATUS = {
    "BLOB_UNKNOWN": 404, "BLOB_UPLOAD_INVALID": 416, "BLOB_UPLOAD_UNKNOWN": 404, "DIGEST_INVALID": 400, "MANIFEST_BLOB_UNKNOWN": 404, "MANIFEST_INVALID": 400, "MANIFEST_UNKNOWN": 404,
    "NAME_INVALID": 400, "NAME_UNKNOWN": 404, "SIZE_INVALID": 400, "UNAUTHORIZED": 401, "DENIED": 403, "UNSUPPORTED": 405, "TOOMANYREQUESTS": 429,
}


#: The greatest unsigned and signed 64-bit numbers.
_U64, _I64 = Decimal(2**64 - 1), Decimal(2**63 - 1)


def byte_range(header: Column, size: Column) -> Column:
    """STRUCT<kind, first, last> of a Range header on a blob: `full` without one, with several or with one that isn't
    valid; `partial`; or `unsatisfiable`, as any range of an empty blob is."""
    head = F.regexp_extract(F.coalesce(F.trim(header), F.lit("")), r"^bytes=\s*([0-9]{1,20})?\s*-\s*([0-9]{1,20})?\s*$", 0)
    a = F.regexp_extract(head, r"=\s*([0-9]+)\s*-", 1)
    b = F.regexp_extract(head, r"-\s*([0-9]+)\s*$", 1)
    # bounds are unsigned 64-bit numbers; as places in a blob those over the signed range are all the same
    wide = lambda x: F.when(x != "", x.cast("decimal(20,0)"))
    over = lambda x: F.coalesce(wide(x) > F.lit(_U64), F.lit(False))
    place = lambda x: F.least(wide(x), F.lit(_I64)).cast("long")
    first, last = F.when(a != "", place(a)), F.when(b != "", place(b))
    made = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("first"), y.cast("long").alias("last"))
    none = F.lit(None)
    return (
        F.when((head == "") | (first.isNull() & last.isNull()) | over(a) | over(b) | (wide(a) > wide(b)), made("full", none, none))
        .when(size == 0, made("unsatisfiable", none, none))
        .when(first.isNull(), F.when(last == 0, made("unsatisfiable", none, none)).otherwise(made("partial", F.greatest(size - last, F.lit(0)), size - 1)))
        .when(first >= size, made("unsatisfiable", none, none))
        .otherwise(made("partial", first, F.least(F.coalesce(last, size - 1), size - 1)))
    )


def if_none_match(header: Column, etag: Column) -> Column:
    """Whether the header names the entity: `*`, or one of its tags, weak or strong."""
    tags = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda t: F.regexp_replace(F.regexp_replace(F.trim(t), "^W/", ""), '^"|"$', ""))
    return (F.trim(header) == "*") | F.array_contains(tags, etag)


def media_type(value: Column) -> Column:
    """A media type without its parameters."""
    return F.trim(F.split_part(value, F.lit(";"), F.lit(1)))


def media_types_agree(content_type: Column, body_type: Column) -> Column:
    """Parameters of either don't count; a body without a media type agrees with any header."""
    return body_type.isNull() | (media_type(content_type) == media_type(body_type))


def artifact_type(body: Column) -> Column:
    """A manifest's artifactType, or its config's media type where that is missing or empty."""
    own = F.get_json_object(body, "$.artifactType")
    return F.coalesce(F.when(own != "", own), F.get_json_object(body, "$.config.mediaType"))


def json_depth(body: Column) -> Column:
    """How deep objects and arrays nest. Strings are cut out first, so brackets in them don't count."""
    bare = F.regexp_replace(F.regexp_replace(body, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    step = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0))
    return F.aggregate(step, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, x: F.struct((s["now"] + x).alias("now"), F.greatest(s["most"], s["now"] + x).alias("most")), lambda s: s["most"])


def error_status(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ERROR_STATUS.items() for x in kv])[code]


def duration_ms(text: Column) -> Column:
    """Milliseconds of a duration such as 1m2.5s; null if it isn't one. Units: h, m, s, ms, us or µs, ns."""
    one = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h)"
    whole = F.regexp_extract(text, rf"^(?:{one})+$", 0)
    scale = F.create_map(*[F.lit(x) for kv in {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "μs": 1e-3, "ms": 1.0, "s": 1e3, "m": 6e4, "h": 3.6e6}.items() for x in kv])
    pieces = F.regexp_extract_all(whole, F.lit(one), F.lit(0))
    part = lambda p: F.regexp_extract(p, r"^([0-9.]+)", 1).cast("double") * scale[F.regexp_extract(p, r"([a-zµμ]+)$", 1)]
    return F.when(whole != "", F.aggregate(pieces, F.lit(0.0), lambda s, p: s + part(p)))
