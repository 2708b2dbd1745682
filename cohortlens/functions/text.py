"""String columns: trimming, keys, source names, age bands, labels, file names and run names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values
LABELS = {"benign": "benign", "malignant": "malignant"}
SAFE_NAME = r"^[A-Za-z0-9_.\-]+$"
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png"]
DEFAULT_EXTENSION = ".jpg"
SLUG_LENGTH = 60
WHITE_SPACE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(x) for x in range(0x2000, 0x200b))
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Remove white space, tabs and newlines at both ends (SQL ``trim`` alone removes blanks only)."""
    return F.trim(c, F.lit(WHITE_SPACE))


def strip_cell(c: Column) -> Column:
    """The same for a plain cell. Most begin and end with a printable ASCII character, which is seen faster than trimmed."""
    return F.when(F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126), c).otherwise(strip(c))


def blank(c: Column) -> Column:
    """Missing text is the empty string."""
    return F.coalesce(c, F.lit("")) == ""


def norm_key(c: Column) -> Column:
    """Lookup key: inner white space collapsed, ends stripped, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def slug(c: Column) -> Column:
    """Readable name from free text: runs of other characters become one underscore, at most 60 characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), F.lit("_")), 1, SLUG_LENGTH)


def is_anonymous(c: Column) -> Column:
    return norm_key(c).isin("", "anonymous")


def to_number(c: Column) -> Column:
    """Double, or NULL where the text is not a finite decimal number."""
    return F.when(strip(c).rlike(NUMBER), strip(c).try_cast("double"))


def age_band(c: Column) -> Column:
    """Ten-year band such as ``50-59``; blank where the age is no finite number."""
    whole = to_number(c).try_cast("bigint")
    low = (F.floor(whole / F.lit(10)) * 10).cast("bigint")
    return F.coalesce(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")), F.lit(""))


def label_of(c: Column) -> Column:
    """Label of a diagnosis, NULL outside the two known ones."""
    pairs = [F.lit(x) for kv in LABELS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(c))


def joined_detail(first: Column, second: Column) -> Column:
    return F.trim(F.concat(first, F.lit(" > "), second), F.lit(" >"))


def is_safe_name(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(SAFE_NAME)


def link_basis(patient: Column, lesion: Column) -> Column:
    return F.when(~blank(patient), "patient").when(~blank(lesion), "lesion").otherwise("image")


def url_extension(c: Column) -> Column:
    """Lower-case file extension of a URL without its query; ``.jpg`` if there is none, NULL if not an image."""
    name = F.substring_index(F.substring_index(c, "?", 1), "/", -1)
    found = F.lower(F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1))
    ext = F.when(found == "", DEFAULT_EXTENSION).otherwise(found)
    return F.when(ext.isin(IMAGE_EXTENSIONS), ext)


def run_name(backbone: Column, method: Column, frac: Column, img: Column, seed: Column, tag: Column | None = None) -> Column:
    """Name of a run from its keys; the resolution is shown only when it is not the usual 224."""
    parts = [backbone, method, F.concat(F.lit("frac"), frac.cast("string")), F.concat(F.lit("seed"), seed.cast("string")),
             F.when(img != 224, F.concat(F.lit("img"), img.cast("string")))]
    return F.concat_ws("_", *parts, *([tag] if tag is not None else []))


def method_family(c: Column) -> Column:
    return F.when(c.startswith("lora"), "lora").otherwise("full")


def fraction_of(c: Column) -> Column:
    """Number in a result key such as ``frac0.3``."""
    return F.substr(c, F.lit(5)).try_cast("double")


def path_number(c: Column) -> Column:
    """Last number in the name of a path's parent folder."""
    folder = F.element_at(F.split(c, "/"), -2)
    return F.element_at(F.regexp_extract_all(folder, F.lit(r"(\d+)"), F.lit(1)), -1).cast("bigint")


def percent(share: Column) -> Column:
    return F.round(F.lit(100.0) * share, 1)


def decimals3(c: Column) -> Column:
    """Three decimals as text, blank for NULL and NaN."""
    return F.when(c.isNull() | F.isnan(c), "").otherwise(F.format_string("%.3f", c.cast("double")))
