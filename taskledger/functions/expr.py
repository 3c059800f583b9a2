"""Column expressions shared by the jobs. All stay in the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
TERMINAL = ("succeeded", "failed", "canceled")
STATUSES = ("queued", "running", "waiting", "succeeded", "failed", "canceled")
INFLIGHT = ("running", "waiting")
SLUG = "^[a-z][a-z0-9-]{0,62}$"
SETTING_PATH = "^[a-z][a-z0-9_-]{0,63}(/[a-z][a-z0-9_-]{0,63})*$"
STREAM_NAME = "^[a-zA-Z_][a-zA-Z0-9_.-]{0,127}$"
ENV_VAR_NAME = "^[A-Za-z_][A-Za-z_0-9]*$"
HEX_DIGEST = "^[a-f0-9]{64}$"
ERROR_CODE = "^[a-z][a-z0-9_.-]{0,127}$"
SEMVER = (
    r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)"
    r"(-(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)(\.(0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*))*)?"
    r"(\+[0-9A-Za-z-]+(\.[0-9A-Za-z-]+)*)?$"
)
UUID_TEXT = "^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
TIME_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
MIME_TYPE = r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+(/[!#$%&'*+.^_`|~0-9A-Za-z-]+)?(\s*;\s*[!#$%&'*+.^_`|~0-9A-Za-z-]+=([!#$%&'*+.^_`|~0-9A-Za-z-]+|\"[^\"]*\"))*\s*;?\s*$"
MEMORY_UNITS = {
    "": 1, "Ki": 2**10, "Mi": 2**20, "Gi": 2**30, "Ti": 2**40,
    "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12,
}
PART_SIZE = 8 * 1024 * 1024
MAX_UPLOAD = 83_886_080_000
INLINE_LIMIT = 64 * 1024
MAX_RECORD = 64 * 1024 * 1024
MAX_BATCH = 128 * 1024 * 1024
MAX_KEY = 1024
MAX_APPEND_ID = 200
READ_LIMIT, READ_LIMIT_MAX = 100, 1000
LOG_VALUE_MIME = "application/cbor"
LOG_BATCH_LINES = 32


def matches(text: Column, pattern: str) -> Column:
    """True where the text matches; false for null. `$` is exact: a trailing line break fails."""
    exact = pattern[:-1] + r"\z" if pattern.endswith("$") else pattern
    return F.coalesce(text.rlike(exact), F.lit(False))


def byte_length(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def as_ntz(moment: datetime | str) -> Column:
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def prefix_end(prefix: bytes) -> bytes | None:
    """The first key after all keys with this prefix; None when there is no such key."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def has_prefix(key: Column, prefix: bytes) -> Column:
    """A range over a binary column, so Parquet can skip row groups by key."""
    if not prefix:
        return F.lit(True)
    end = prefix_end(prefix)
    inside = key >= F.lit(bytearray(prefix))
    return inside if end is None else inside & (key < F.lit(bytearray(end)))


def time_text(ts: Column) -> Column:
    """UTC time with seconds and, only when not zero, the shortest fraction."""
    fraction = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("Z"),
    )


def parses_as_time(text: Column) -> Column:
    """Shape with 0-9 fraction digits, plus a real date and time of day."""
    whole = F.regexp_replace(F.substring(text, 1, 19), "T", " ")
    return matches(text, TIME_TEXT) & F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()


def nanos_to_time(nanos: Column) -> Column:
    """The microsecond at or before a number of nanoseconds, in whole numbers throughout."""
    nanos = nanos.cast("long")
    below = F.pmod(nanos, F.lit(1000).cast("long"))
    return F.timestamp_micros(F.call_function("div", nanos - below, F.lit(1000).cast("long")))


def elapsed_seconds(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.format_string("%.3f", micros / F.lit(1_000_000.0))


def page_token(ts: Column, row_id: Column) -> Column:
    """base64url of `time|id` without padding."""
    raw = F.base64(F.encode(F.concat_ws("|", time_text(ts), row_id.cast("string")), "UTF-8"))
    return F.regexp_replace(F.translate(raw, "+/", "-_"), "=+$", "")


def read_page_token(token: Column) -> Column:
    """The (time, id) inside a page token; null when the token is malformed."""
    text = F.translate(token, "-_", "+/")
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    parts = F.split(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), r"\|")
    return F.when(
        (F.size(parts) == 2) & parses_as_time(parts[0]),
        F.struct(
            F.try_to_timestamp(parts[0]).cast("timestamp_ntz").alias("created_at"), parts[1].alias("id")
        ),
    )


def blob_uri(mime: Column, digest_hex: Column) -> Column:
    return F.concat(F.lit("blob:"), mime, F.lit(","), F.base64(F.unhex(digest_hex)))


def uri_attributes(uri: Column) -> Column:
    """Base address, resolve flag and mime type of a value reference with `;` attributes."""
    head = F.substring_index(uri, ",", 1)
    is_inline = uri.startswith("data:") | uri.startswith("blob:")
    pieces = F.when(is_inline, F.split(head, ";")).otherwise(F.split(uri, ";"))
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    own = F.filter(
        rest,
        lambda p: (p == "resolve") | p.startswith("resolve=") | p.startswith("mime=") | ~is_inline,
    )
    kept = F.filter(rest, lambda p: ~F.array_contains(own, p))
    base = F.when(
        is_inline,
        F.concat(
            F.array_join(F.concat(F.array(pieces[0]), kept), ";"),
            F.lit(","),
            F.substring(uri, F.length(head) + 2, F.length(uri)),
        ),
    ).otherwise(pieces[0])
    named = F.filter(own, lambda p: p.startswith("mime="))
    # The default type is what stands between the scheme and the first `;`.
    inline_mime = F.substring_index(F.substring(head, 6, F.length(head)), ";", 1)
    default = (
        F.when(uri.startswith("data:") & (inline_mime == ""), F.lit("text/plain"))
        .when(is_inline, inline_mime)
        .otherwise(F.lit("application/octet-stream"))
    )
    last_flag = F.try_element_at(F.filter(own, lambda p: p.startswith("resolve=")), F.lit(-1))
    return F.struct(
        base.alias("base"),
        (F.array_contains(own, "resolve") | F.coalesce(last_flag == "resolve=true", F.lit(False))).alias(
            "resolve"
        ),
        F.when(F.size(named) > 0, F.try_url_decode(F.substring(F.try_element_at(named, F.lit(-1)), 6, 2**31 - 1)))
        .otherwise(default)
        .alias("mime_type"),
    )


def checkpoint_key(action: Column, kind: str, name: Column) -> Column:
    return F.concat_ws("/", action.cast("string"), F.lit(kind), name)


def framed_hex(*parts: Column) -> Column:
    """Hex of each part with its 8-byte big-endian length in front."""
    return F.concat(
        *[F.concat(F.lpad(F.hex(byte_length(p)), 16, "0"), F.coalesce(F.hex(p), F.lit(""))) for p in parts]
    )


def framed_sha256(*parts: Column) -> Column:
    return F.sha2(F.unhex(framed_hex(*parts)), 256)


def event_append_id(action: Column, key: Column, event_id: Column) -> Column:
    return F.concat_ws(":", action.cast("string"), framed_sha256(key, event_id))


def backoff_seconds(failures: Column) -> Column:
    """1 s after the first failure, doubling, at most 64 s."""
    steps = F.least(F.greatest(failures - 1, F.lit(0)), F.lit(6))
    return F.pow(F.lit(2.0), steps).cast("int")


def part_count(size: Column) -> Column:
    return F.floor((size + F.lit(PART_SIZE - 1)) / F.lit(PART_SIZE))


def memory_bytes(text: Column) -> Column:
    """`512Mi`, `1G` or plain bytes as a number; null when malformed, zero or over 64 bits."""
    unit = F.regexp_extract(text, "^[0-9]+(Ki|Mi|Gi|Ti|K|M|G|T)?$", 1)
    factor = F.create_map(*[F.lit(x) for pair in MEMORY_UNITS.items() for x in (pair[0], int(pair[1]))])
    number = F.regexp_extract(text, "^([0-9]+)", 1).try_cast("decimal(20,0)")
    size = (number * factor[unit].cast("decimal(13,0)")).cast("decimal(38,0)")
    ok = matches(text, "^[0-9]+(Ki|Mi|Gi|Ti|K|M|G|T)?$") & (size > 0)
    return F.when(ok & (size <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")), size)


def cpu_millis(cores: Column) -> Column:
    """Cores as whole thousandths; null when not positive, fractional or over 32 bits."""
    millis = cores.try_cast("decimal(38,18)") * 1000
    whole = millis.cast("decimal(15,0)")
    return F.when((millis == whole) & (millis > 0) & (whole <= 2**32 - 1), whole.cast("long"))


def safe_path(name: Column) -> Column:
    """Relative, no empty or dot parts, no backslash, no NUL; one trailing slash is allowed."""
    parts = F.split(F.regexp_replace(name, "/$", ""), "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(
        (name != "") & ~bad & ~name.contains("\\") & ~name.contains("\0") & ~name.startswith("/"),
        F.lit(False),
    )


def normal_path(path: Column) -> Column:
    """Resolve `.`, `..` and repeated slashes in a relative path; leading `..` parts stay."""
    start = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        start,
        lambda done, part: F.when(part.isin("", "."), done)
        .when(
            (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.array_join(parts, "/")


def safe_link(name: Column, target: Column) -> Column:
    """A link may point inside the archive, or below /usr or /nix/store; nowhere else."""
    # A leading .. above the root of an absolute path has no effect.
    absolute = F.regexp_replace(normal_path(target), r"^(\.\./)+|^\.\.$", "")
    inside_roots = absolute.rlike(r"^(usr|nix/store)(/|\z)")
    folder = F.regexp_extract(name, "^(.*)/[^/]*$", 1)
    relative = normal_path(F.concat_ws("/", folder, target))
    stays = (relative != "..") & ~relative.startswith("../")
    clean = (target != "") & ~target.contains("\0") & ~target.contains("\\")
    return F.coalesce(clean & F.when(target.startswith("/"), inside_roots).otherwise(stays), F.lit(False))


def text_lines(text: Column) -> Column:
    """Lines as Python's splitlines gives them, with one empty line for an empty text."""
    breaks = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
    whole = F.regexp_replace(text, rf"({breaks})\z", "")
    return F.split(whole, breaks)
