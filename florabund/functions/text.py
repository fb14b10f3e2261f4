"""Column functions for list cells, attribute strings, header and id forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_of_list(c: Col, sep: str = ",") -> Column:
    """First element of a list cell; null for a null or empty first element."""
    return F.nullif(F.split_part(_c(c), F.lit(sep), F.lit(1)), F.lit(""))


def list_items(c: Col, sep: str = ",") -> Column:
    """Non-empty elements of a list cell."""
    return F.filter(F.split(_c(c), sep), lambda x: x != "")


def split_categories(c: Col) -> Column:
    """'AB' -> ['A', 'B']: each letter is a category."""
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


def attribute_pairs(c: Col) -> Column:
    """'a=b;c=d' -> array of struct(key, value); pieces without '=' are left out."""
    pairs = F.transform(F.split(_c(c), ";"), lambda p: F.struct(F.trim(F.regexp_extract(p, r"^\s*([^=\s]+)=(.*)$", 1)).alias("key"), F.regexp_extract(p, r"^\s*([^=\s]+)=(.*)$", 2).alias("value")))
    return F.filter(pairs, lambda p: p["key"] != "")


def parse_attributes(c: Col) -> Column:
    """'a=b;c=d' -> map; of a repeated key the last value counts."""
    pairs = attribute_pairs(c)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, last)


def bad_attributes(c: Col) -> Column:
    """Non-empty pieces of an attribute string that are not key=value."""
    return F.filter(F.split(_c(c), ";"), lambda p: (F.trim(p) != "") & ~p.rlike(r"^\s*[^=\s]+="))


def extract_tag(c: Col, tag: str) -> Column:
    """Value of one tag, whatever its case; null where it is missing."""
    return F.nullif(F.regexp_extract(_c(c), rf"(?i)(?:^|;)\s*{tag}=([^;]*)", 1), F.lit(""))


def last_token_trim(c: Col, strict: bool = False) -> Column:
    """Without trailing white space; strict keeps only the last token."""
    return F.regexp_extract(_c(c), r"(\S*)\s*$", 1) if strict else F.regexp_replace(_c(c), r"\s+$", "")


def fix_strand(c: Col) -> Column:
    """1 -> +, -1 -> -; anything else stays."""
    return F.when(_c(c) == "1", "+").when(_c(c) == "-1", "-").otherwise(_c(c))


def fix_quotes(c: Col) -> Column:
    return F.translate(_c(c), '"', "'")


def fix_product_semicolon(c: Col) -> Column:
    """The last ';' inside product=... of a line becomes ','; a ';' that begins another tag stays."""
    return F.regexp_replace(_c(c), r"(product=[^=]*);(?=[^=]*$)", "$1,")


def fix_space_tags(c: Col) -> Column:
    """'name x; y z' -> 'name=x;y=z' on lines in that style."""
    spaced = F.regexp_replace(F.regexp_replace(_c(c), r";\s+", ";"), r"(^|;)(\w+) ", "$1$2=")
    return F.when(_c(c).rlike(r"(^|;\s*)name "), spaced).otherwise(_c(c))


def fasta_id(c: Col) -> Column:
    """A FASTA header up to its first space; other lines stay."""
    return F.when(_c(c).startswith(">"), F.regexp_extract(_c(c), r"^(\S+)", 1)).otherwise(_c(c))


def underscore_names(c: Col) -> Column:
    return F.replace(_c(c), F.lit(" "), F.lit("_"))


def na_to_null(c: Col, *more: str) -> Column:
    """'NA' and the markers in more -> null."""
    return F.when(~_c(c).isin("NA", *more), _c(c))


def null_to_na(c: Col) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit("NA"))


def percent_share(n: Col, total: Col) -> Column:
    return _c(n).cast("double") / _c(total) * 100.0


def match_ci(a: Col, b: Col) -> Column:
    return F.lower(_c(a)) == F.lower(_c(b))
