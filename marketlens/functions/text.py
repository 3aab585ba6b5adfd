"""Text columns: normalised forms, similarity, contacts, URLs and JSON kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def plain(s: Column) -> Column:
    """Lower case, letters, digits and blanks only, trimmed; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9 ]", ""))


def collapsed(s: Column) -> Column:
    """Lower case, trimmed, runs of white space as one blank; punctuation stays."""
    return F.lower(F.regexp_replace(F.trim(s), r"\s+", " "))


def compact(s: Column) -> Column:
    """Lower case, letters and digits only: a key for deduplication."""
    return F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two plain() forms; 0 where either is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1.0 - F.levenshtein(a, b) / F.greatest(longer, F.lit(1)))


def join_present(sep: str, *parts: Column) -> Column:
    """Parts that are neither null nor empty, joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def shorten(s: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit(mark))).otherwise(s)


def tags(s: Column) -> Column:
    """Comma-separated tags as an array, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_word(s: Column) -> Column:
    return F.get(F.split(s, " "), F.lit(0))


def blank_to_null(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def clean_phone(s: Column, plus: bool = True) -> Column:
    """Ten digits get +1, eleven from 1 get +, anything else is null. Without plus the same digits without the sign."""
    digits, sign = F.regexp_replace(s, r"\D", ""), "+" if plus else ""
    return F.when(F.length(digits) == 10, F.concat(F.lit(f"{sign}1"), digits)).when(
        (F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit(sign), digits)
    )


def first_phone(s: Column) -> Column:
    """The first US-style number in a text, cleaned; null without one."""
    return clean_phone(F.nullif(F.regexp_extract(s, r"(?:\+?1[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", 0), F.lit("")))


def zip_code(s: Column) -> Column:
    """The first five-digit word, empty without one."""
    return F.regexp_extract(s, r"\b(\d{5})\b", 1)


#: The states' codes.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
)


def city_state(s: Column) -> Column:
    """(city, state) of 'New Orleans, LA': the first comma goes, and a last word that is a state's code is the state; else all is the city."""
    text = F.trim(s)
    at = F.instr(text, ",")
    parts = F.split(F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text)))).otherwise(text), r"\s+")
    last = F.upper(F.element_at(parts, -1))
    known = last.isin(*STATES) & (F.size(parts) > 1)
    city = F.when(known, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")).otherwise(text)
    return F.struct(city.alias("city"), F.when(known, last).otherwise("").alias("state"))


def locality(s: Column, city: str, state: str) -> Column:
    """(city, state, zip) of 'Austin, TX 78701'; what is missing is the search's own city and state, or no zip."""
    parts = F.split(F.coalesce(s, F.lit("")), ",")
    first = F.nullif(F.trim(parts[0]), F.lit(""))
    second = F.nullif(F.get(F.split(F.trim(F.get(parts, F.lit(1))), " "), F.lit(0)), F.lit(""))
    return F.struct(F.coalesce(first, F.lit(city)).alias("city"), F.coalesce(second, F.lit(state)).alias("state"), F.regexp_extract(F.coalesce(s, F.lit("")), r"\d{5}", 0).alias("zip"))


def sheet_id(url: Column) -> Column:
    """The id in a sheet's URL; null without one."""
    return F.nullif(F.regexp_extract(url, "/spreadsheets/d/([a-zA-Z0-9_-]+)", 1), F.lit(""))


def extension(name: Column) -> Column:
    """A file name's extension in lower case; a name without a dot is its own."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def with_suffix(s: Column, more: Column, n: int = 80) -> Column:
    """'title — the first n characters of more', or the title alone where there is no more."""
    return F.when(F.coalesce(more, F.lit("")) == "", s).otherwise(F.concat(s, F.lit(" — "), F.substring(more, 1, n)))


def first_underscore(s: Column) -> Column:
    """The first _ as a blank."""
    return F.regexp_replace(s, "^([^_]*)_", "$1 ")


def fitted(s: Column, n: int) -> Column:
    """Cut or filled up with blanks to n characters."""
    return F.rpad(F.substring(F.coalesce(s, F.lit("")), 1, n), n, " ")


def first_named(s: Column, table: dict[str, str]) -> Column:
    """The value of the first name that a text holds, whatever its case; null without one."""
    return F.coalesce(*[F.when(F.lower(s).contains(k.lower()), v) for k, v in table.items()])


def emails(s: Column) -> Column:
    """Distinct lower-cased addresses in order of appearance; none for null."""
    found = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(EMAIL), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def valid_emails(found: Column, denied: tuple[str, ...]) -> Column:
    """Addresses of 6 to 100 characters whose domain isn't denied and that aren't file names."""
    ok = lambda e: F.length(e).between(6, 100) & ~F.element_at(F.split(e, "@"), -1).isin(*denied) & ~e.rlike(r"\.(png|jpg|jpeg|gif|svg|webp)$")
    return F.filter(found, ok)


def host(url: Column) -> Column:
    """A URL's host without www., null where it has none."""
    return F.regexp_replace(F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit("")), r"^www\.", "")


def clean_url(url: Column) -> Column:
    """With a scheme, without query and trailing slash; null for blank."""
    u = blank_to_null(url)
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), "/+$", "")


def json_list(s: Column) -> Column:
    """A JSON array of strings kept as text; null and malformed text are empty."""
    return F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))


def json_map(s: Column) -> Column:
    return F.coalesce(F.from_json(s, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_shown(s: Column) -> Column:
    """A JSON array as 'a, b', or the raw text where it is malformed."""
    return F.coalesce(F.array_join(F.from_json(s, "array<string>"), ", "), s)
