"""Conditions and code tables as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import is_blank, is_primary, version_newer

#: Error kind, HTTP status, whether the target is at fault, whether a retry may help.
ERRORS = (
    ("session_error", 403, True, True),
    ("cookie_expired", 403, True, True),
    ("upgrade_required", 426, True, False),
    ("under_maintenance", 503, False, False),
    ("signature_error", 500, True, False),
    ("no_account", 503, True, False),
    ("no_client", 503, True, False),
    ("invalid_server_region", 400, False, False),
    ("invalid_http_status", 502, True, False),
    ("crypto", 500, True, False),
    ("parse", 400, False, False),
    ("upstream_data", 502, True, False),
    ("network", 502, True, True),
    ("database", 500, True, False),
    ("redis", 500, True, False),
    ("io", 500, True, False),
    ("auth", 401, False, False),
    ("not_found", 404, False, False),
    ("forbidden", 403, False, False),
    ("internal", 500, True, False),
    ("unknown", 502, False, False),
)

#: Upstream statuses and their names.
STATUSES = {
    200: "ok", 400: "client_error", 403: "session_error", 404: "not_found",
    409: "conflict", 426: "game_upgrade", 500: "server_error", 503: "under_maintenance",
}


def known_kind(kind: Column) -> Column:
    """The kind itself; kinds that are not known count as ``internal``."""
    return F.when(kind.isin(*[e[0] for e in ERRORS]), kind).otherwise(F.lit("internal"))


def error_status(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for e in ERRORS for x in e[:2]])
    return F.try_element_at(table, known_kind(kind))


def is_target_fault(kind: Column) -> Column:
    return known_kind(kind).isin(*[e[0] for e in ERRORS if e[2]])


def is_retryable(kind: Column) -> Column:
    return known_kind(kind).isin(*[e[0] for e in ERRORS if e[3]])


def status_name(code: Column) -> Column:
    """The name of a known status, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for e in STATUSES.items() for x in e]), code.cast("int"))


def digits_only(text: Column) -> Column:
    """Digits and nothing else; the empty text passes."""
    return text.rlike(r"^[0-9]*$")


def image_parameters(region: Column, first: Column, second: Column) -> Column:
    """Primary regions take two hashes of 64 hex digits, the others two numbers."""
    both = lambda p: first.rlike(p) & second.rlike(p)
    return F.when(is_primary(region), both("^[a-f0-9]{64}$")).otherwise(both(r"^[0-9]+$"))


def thumbnail_parameters(first: Column, second: Column) -> Column:
    uuid = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    return first.rlike("^[a-f0-9]{64}$") & second.rlike(uuid)


def safe_path_part(text: Column) -> Column:
    return ~text.isin("", ".", "..") & ~text.contains("/") & ~text.contains("\\") & ~text.contains("\0")


def needs_sync(remote: Column, local: Column, remote_cdn: Column, local_cdn: Column) -> Column:
    return ((remote != "") & (remote != local)) | (remote_cdn > local_cdn)


def version_differs(new: Column, current: Column) -> Column:
    """Newer; blank never; what does not parse counts as new if it differs."""
    return F.when(is_blank(new), F.lit(False)).otherwise(F.coalesce(version_newer(new, current), new != current))


def cdn_changes(data: Column, asset: Column, cdn: Column, current_data: Column, current_cdn: Column) -> Column:
    """``master, asset, save`` for secondary regions."""
    master = cdn > current_cdn
    return F.struct(
        master.alias("master"),
        (master & ~is_blank(asset)).alias("asset"),
        (master | (~is_blank(data) & (data != current_data))).alias("save"),
    )


def flag(text: Column, default: bool) -> Column:
    """``true`` or ``false`` in any case; absent or empty is the default, anything else null."""
    low = F.lower(text)
    return F.when(text.isNull() | (text == ""), F.lit(default)).when(low == "true", True).when(low == "false", False)
