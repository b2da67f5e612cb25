"""Scalar functions over text columns, all built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions whose versions and hashes follow the primary rules; the others follow the secondary ones.
REGIONS = ("jp", "en", "tw", "kr", "cn")
PRIMARY_REGIONS = ("jp", "en")

#: Attributes of a Set-Cookie header that are no cookies.
COOKIE_ATTRIBUTES = ("domain", "path", "expires", "max-age", "samesite", "priority", "version", "comment", "commenturl", "port")

#: Table keys that a record type has besides the regular ones.
EXTRA_TABLE_KEYS = {
    "CustomProfileCollectionGacha": ("customProfileGachas",),
    "CustomProfileCollectionGachaBehavior": ("customProfileGachaBehaviors",),
    "CustomProfileCollectionGachaDetail": ("customProfileGachaDetails",),
    "Font": ("customProfileTextFonts",),
    "Resource": (
        "customProfileCollectionResources",
        "customProfileEtcResources",
        "customProfileGeneralBackgroundResources",
        "customProfileMemberStandingPictureResources",
        "customProfilePlayerInfoResources",
        "customProfileShapeResources",
        "customProfileStoryBackgroundResources",
    ),
    "ResourceExcludeCard": ("customProfileMemberResourceExcludeCards",),
    "TextColor": ("customProfileTextColors",),
}


def is_primary(region: Column) -> Column:
    return F.lower(region).isin(*PRIMARY_REGIONS)


def trimmed(c: Column) -> Column:
    """White space of every kind off both ends; Spark's own trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def first_non_blank(*columns: Column) -> Column:
    """The first column that is not blank, untrimmed; else the empty text."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in columns], F.lit(""))


def version_segments(version: Column) -> Column:
    """A dotted version as numbers of 32 bits; null if a segment is none."""
    parts = F.transform(F.split(version, r"\."), lambda x: F.when(x.rlike(r"^\+?[0-9]+$"), x.try_cast("bigint")))
    return F.when(F.forall(parts, lambda x: x.isNotNull() & (x <= 4294967295)), parts)


def version_newer(new: Column, current: Column) -> Column:
    """Whether ``new`` is newer; the shorter side is padded with zeros. Null if one does not parse."""
    a, b = version_segments(new), version_segments(current)
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(x)))
    return F.when(a.isNotNull() & b.isNotNull(), pad(a) > pad(b))


def effective_version(region: Column, version: Column) -> Column:
    """In secondary regions a version of three numbers has 0 as its last; others stay."""
    numeric = version.rlike(r"^\+?[0-9]+(\.\+?[0-9]+){2}$") & version_segments(version).isNotNull()
    return F.when(~is_primary(region) & numeric, F.regexp_replace(version, r"[^.]+$", "0")).otherwise(version)


def camel_to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z])", "_$1"))


def plural(word: Column) -> Column:
    """An English plural; a word that ends in s stays."""
    return (
        F.when(word.endswith("s"), word)
        .when(word.rlike("(ch|sh|x|z)$"), F.concat(word, F.lit("es")))
        .when(word.rlike("y$") & ~word.rlike("[aeou]y$"), F.regexp_replace(word, "y$", "ies"))
        .otherwise(F.concat(word, F.lit("s")))
    )


def camel_case(name: Column) -> Column:
    """Leading capitals lowered, the last of them only if no small letter follows it."""
    head = F.regexp_extract(name, r"^([A-Z]+(?=[A-Z][^A-Z ])|[A-Z]+)", 1)
    return F.concat(F.lower(head), F.substring(name, F.length(head) + 1, F.length(name)))


def table_keys(record: Column) -> Column:
    """All table keys under which rows of a record type may come, without repeats."""
    bare = F.regexp_replace(record, "^Master", "")
    bare = F.when(bare.endswith("Model") & (F.length(bare) > 5), F.regexp_replace(bare, "Model$", "")).otherwise(bare)
    key = F.replace(F.replace(camel_case(bare), F.lit("2D"), F.lit("2d")), F.lit("3D"), F.lit("3d"))
    more = (
        F.when(key.endswith("y"), F.regexp_replace(key, "y$", "ies"))
        .when(key.rlike("(s|ch|sh|x)$"), F.concat(key, F.lit("es")))
        .otherwise(F.concat(key, F.lit("s")))
    )
    extra = F.array().cast("array<string>")
    for name, keys in EXTRA_TABLE_KEYS.items():
        extra = F.when(bare == name, F.array(*map(F.lit, keys))).otherwise(extra)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(key, more), extra)))


def percent_encode(text: Column) -> Column:
    """RFC 3986: letters, digits and ``-._~`` stay, other UTF-8 bytes become %XX."""
    out = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(plain))
    return out


def base64_text(text: Column) -> Column:
    """Decode standard or URL-safe base64, padded or not; null if it is neither."""
    plain = F.regexp_replace(F.translate(text, "-_", "+/"), "=+$", "")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
    fits = plain.rlike("^[A-Za-z0-9+/]*$") & (F.length(plain) % 4 != 1)
    return F.when(fits, F.decode(F.unbase64(F.when(fits, padded).otherwise("")), "UTF-8"))


def base64_encode(text: Column) -> Column:
    """Standard base64 in one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")


def jwt_field(token: Column, field: str) -> Column:
    """A field of a token's payload; null unless it has three parts and the field is not empty."""
    parts = F.split(token, r"\.")
    value = F.get_json_object(base64_text(F.get(parts, F.lit(1))), f"$.{field}")
    return F.when((F.size(parts) == 3) & (value != ""), value)


def wrapped_jwt_field(token: Column, field: str) -> Column:
    """The same for a token that is encoded once more as a whole."""
    return jwt_field(base64_text(token), field)


def as_text(json_value: Column) -> Column:
    """A JSON null, number or string as text; null is the empty text."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json_value), "$", "string"), F.lit(""))


def path_region(path: Column) -> Column:
    """The path's segment after a leading ``api`` or ``image``, or its first, in lower case."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    first = F.get(parts, F.lit(0))
    return F.coalesce(F.lower(F.when(first.isin("api", "image"), F.get(parts, F.lit(1))).otherwise(first)), F.lit(""))


def cookies(headers: Column) -> Column:
    """The ``name=value`` pairs of an array of Set-Cookie headers, without attributes."""
    pairs = F.filter(F.flatten(F.transform(headers, lambda h: F.split(h, ";"))), lambda x: x.contains("="))
    split = F.transform(pairs, lambda x: F.struct(trimmed(F.substring_index(x, "=", 1)).alias("name"), trimmed(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    kept = F.filter(split, lambda x: (x["name"] != "") & ~F.lower(x["name"]).isin(*COOKIE_ATTRIBUTES))
    return F.array_join(F.transform(kept, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "; ")


def region_label(label: Column) -> Column:
    """A region for log lines: quotes and blanks off, in capitals."""
    return F.upper(trimmed(F.btrim(trimmed(label), F.lit('"'))))


def redact(user: Column) -> Column:
    """All but the last four bytes hidden; texts of four characters or fewer wholly.

    A character that the cut goes through becomes U+FFFD.
    """
    tail = F.make_valid_utf8(F.substring(F.encode(user, "UTF-8"), -4, 4).cast("string"))
    return F.when(F.length(user) <= 4, F.lit("****")).otherwise(F.concat(F.lit("***"), tail))


def duration_text(micros: Column) -> Column:
    return F.when(micros >= 1000, F.format_string("%.3f ms", micros / 1000)).otherwise(F.format_string("%.1f us", micros))


def json_field_name(name: Column) -> Column:
    trimmed = F.regexp_replace(name, "^_+", "")
    return F.when(trimmed == "", name).otherwise(camel_case(trimmed))


def fill_template(template: Column, user: Column, region: Column) -> Column:
    return F.replace(F.replace(template, F.lit("{userId}"), user), F.lit("{region}"), region)
