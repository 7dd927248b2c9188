"""Column expressions: values, attributes, buckets, dates, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .durations import SpecError

NUMERIC = r"^-?[0-9]+(\.[0-9]+)?$"

# The patterns of card, social security and account numbers, and their replacements.
REDACTIONS = (
    (r"\b(?:\d[ -]*?){13,19}\b", "[REDACTED-CC]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED-SSN]"),
    (r"\b[A-Z]{2}\d{2}[A-Z0-9]{12,30}\b", "[REDACTED-IBAN]"),
)
# What stands for the hidden part of a contact, and the keys whose values are contacts.
DOTS = "\u2022\u2022\u2022"
CONTACT_KEYS = ("email", "email_address", "phone", "phone_number", "msisdn", "e164", "mobile", "tel")


def number(text: Column) -> Column:
    """The number that a text is, wholly; else null, never an error."""
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def canonical_url(url: Column) -> Column:
    """Without query and fragment."""
    return F.split_part(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))


def canonical(text: str) -> str:
    return str(text).split("?")[0].split("#")[0]


def canonical_url_keeping(url: Column, keep: list[str]) -> Column:
    """Without fragment, and with only the named query parameters: the first of each, in the order of the list, in any case."""
    plain = canonical_url(url)
    query = F.split_part(F.substr(url, F.length(plain) + 2), F.lit("#"), F.lit(1))
    named = lambda k: F.get(F.filter(F.split(query, "&"), lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1))) == k.lower()), 0)
    kept = F.array_compact(F.array(*map(named, keep))) if keep else F.array().cast("array<string>")
    return F.when(F.size(kept) > 0, F.concat(plain, F.lit("?"), F.array_join(kept, "&"))).otherwise(plain)


def redact(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def attribute(columns: list[str], key: str) -> Column:
    """A key of the open map `meta`, from its own column if it has been given one."""
    promoted = f"attr_{key}"
    return F.col(promoted) if promoted in columns else F.get_json_object("meta", f"$['{key}']")


def plain_text(value: Column) -> Column:
    """A value as text, whole numbers without a point."""
    return F.when(F.typeof(value).isin("double", "float"), F.regexp_replace(value.cast("string"), r"\.0$", "")).otherwise(value.cast("string"))


def text_of(value) -> str:
    """A bound as the text that an attribute would hold."""
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def bucket_of_time(grain: str, ts: Column) -> Column:
    forms = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
    if grain == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
    if grain not in forms:
        raise SpecError(f"group: {grain!r} is no time grain")
    return F.date_format(ts, forms[grain])


def band(value: Column, width: float) -> Column:
    low = (F.floor(value / width) * width).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + int(width) - 1).cast("string"))


def age(unit: str, born: Column, now: Column) -> Column:
    """Whole years, months or days from one instant to another; a month that has not come round does not count."""
    if unit == "days":
        return F.floor((F.unix_timestamp(now) - F.unix_timestamp(born)) / 86400)
    tail = lambda t, form: F.date_format(t, form)
    if unit == "years":
        return F.year(now) - F.year(born) - F.when(tail(now, "MMddHHmmss") < tail(born, "MMddHHmmss"), 1).otherwise(0)
    if unit == "months":
        whole = (F.year(now) - F.year(born)) * 12 + F.month(now) - F.month(born)
        return whole - F.when(tail(now, "ddHHmmss") < tail(born, "ddHHmmss"), 1).otherwise(0)
    raise SpecError(f"computed: unit {unit!r} is none of years, months, days")


def value_type(text: Column) -> Column:
    return (
        F.when(text.isNull(), F.lit(None))
        .when(text.rlike(NUMERIC), "number")
        .when(F.lower(text).isin("true", "false"), "bool")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), "date")
        .otherwise("string")
    )


def mask_email(text: Column) -> Column:
    """First letter of the name, and what follows the first @; without a name before it as any other text."""
    at = F.instr(text, "@")
    return F.when(at > 1, F.concat(F.substring(text, 1, 1), F.lit(DOTS + "@"), F.substr(text, at + 1))).otherwise(mask(text))


def mask_phone(text: Column) -> Column:
    """The first digits, with the country's if there is a plus sign, and the last two; short numbers not at all."""
    digits = F.regexp_replace(text, "[^0-9+]", "")
    head = F.when(F.startswith(digits, F.lit("+")), F.substring(digits, 1, 4)).otherwise(F.substring(digits, 1, 2))
    return F.when(F.length(digits) < 5, F.lit(DOTS)).otherwise(F.concat(head, F.lit(DOTS), F.right(digits, F.lit(2))))


def mask(text: Column) -> Column:
    """The first letter; a text of one letter not at all."""
    return F.when(F.length(text) <= 1, F.lit(DOTS)).otherwise(F.concat(F.substring(text, 1, 1), F.lit(DOTS)))


def mask_identity(kind: str, text: Column) -> Column:
    """A contact of a kind masked by the kind's rule; none is the empty text."""
    return F.coalesce({"email": mask_email, "phone": mask_phone}.get(kind, mask)(text), F.lit(""))


def refuse_contact_key(key: str) -> None:
    """Contacts are no dimension of a chart."""
    if key.lower() in CONTACT_KEYS:
        raise SpecError(f'"{key}" holds contacts and cannot be grouped by')


def e164(text: Column, country: str | None = None) -> Column:
    """A phone number as + and 7 to 15 digits: 00 is a plus sign, one leading 0 gives way to the country's code.

    A number that begins with the country's code already is given a plus sign only.  What is no number stays if it begins
    with a plus sign, else it is null.
    """
    plain = F.trim(text)
    digits = F.regexp_replace(F.regexp_replace(plain, r"[\s().\-/]", ""), "^00", "+")
    if country is not None:
        local = F.concat(F.lit("+" + country), F.regexp_replace(digits, "^0", ""))
        digits = F.when(F.startswith(digits, F.lit("+")), digits).when(F.startswith(digits, F.lit(country)), F.concat(F.lit("+"), digits)).otherwise(local)
    return F.when(digits.rlike(r"^\+[1-9][0-9]{6,14}$"), digits).when(F.startswith(plain, F.lit("+")), plain)


# The calling codes of one and two digits; all others have three.
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def calling_code(phone: Column) -> Column:
    """The country's code, with its plus sign, that a number in E.164 begins with; null for anything else."""
    return F.nullif(F.regexp_extract(phone, rf"^(\+(?:{CALLING_CODES}|[0-9]{{3}}))[0-9]{{4,}}$", 1), F.lit(""))


def feed_text(text: Column, most: int = 200) -> Column:
    """One line of at most so many characters, the last one a sign that there was more; no text is null."""
    line = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("\u2026"))).when(line != "", line)


def without_type_echo(preview: Column, content_id: Column) -> Column:
    """A preview without a first part that only restates the type, which are the first two parts of content_id; nothing else is null.

    Parts stand between dashes or bars with white space around; letters count, whatever their case.  A label that was cut short, or goes on
    by up to four letters, still restates it.
    """
    letters = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))
    name = letters(F.regexp_extract(content_id, "^([^:]*:?[^:]*)", 1))
    parts = F.split(preview, r"\s+[\u2014\u2013|]\s+")
    first = letters(F.get(parts, F.lit(0)))
    echo = (first == name) | ((F.length(first) <= F.length(name) + 4) & F.startswith(name, first))
    kept = F.trim(F.array_join(F.when(echo, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), " \u2014 "))
    return F.nullif(F.when(F.coalesce(name, F.lit("")) == "", preview).otherwise(kept), F.lit(""))


def decoded_path(url: Column) -> Column:
    """The path of a URL with its escapes decoded, or as it is if they are broken; for the root the host."""
    path = F.regexp_replace(canonical_url(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    shown = F.when(path.isin("", "/") & (host != ""), host).otherwise(path)
    return feed_text(F.coalesce(F.try_url_decode(F.replace(shown, F.lit("+"), F.lit("%2B"))), shown))


def contact_hash(text: Column, kind: str) -> Column:
    plain = F.lower(F.trim(text)) if kind == "email" else F.regexp_replace(text, "[^0-9]", "")
    return F.sha2(plain, 256)


def canonical_json(value: Column) -> Column:
    """A JSON object or array with the keys of all its objects sorted, at every depth; any other text as it is."""
    nested = F.substring(F.ltrim(value), 1, 1).isin("{", "[")
    return F.when(nested, F.coalesce(F.to_json(F.try_parse_json(value)), value)).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def engagement_blend(similarity: Column, engagement: Column) -> Column:
    return similarity * (F.lit(0.4) + F.lit(0.6) * engagement)


# Fixed value: a sentence is what stands before one of these signs or the end of a line, with it and the white space after it.
SENTENCE = r"[^.!?\n]+[.!?\n]?\s*"


def sentences_to_chunks(text: Column, most_words: int = 200) -> Column:
    """Sentences packed in order into chunks of at most so many words; a longer sentence is a chunk of its own.

    A text of signs only is one sentence; one without anything but white space has no chunk, as has null.
    """
    stripped = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    sentences = F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(text)), stripped)
    words = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"\S+"), F.lit(0)))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def pack(state, sentence):
        fits = (F.size(state["open"]) == 0) | (state["n"] + words(sentence) <= most_words)
        done = F.when(fits, state["done"]).otherwise(F.array_append(state["done"], stripped(F.array_join(state["open"], " "))))
        return F.struct(done.alias("done"), F.when(fits, F.array_append(state["open"], sentence)).otherwise(F.array(sentence)).alias("open"), F.when(fits, state["n"] + words(sentence)).otherwise(words(sentence)).alias("n"))

    packed = F.aggregate(sentences, start, pack, lambda s: F.when(F.size(s["open"]) == 0, s["done"]).otherwise(F.array_append(s["done"], stripped(F.array_join(s["open"], " ")))))
    return F.when(text.rlike(r"\S"), packed).otherwise(none)


# Fixed value: the signs of a code.
CODE_SIGNS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def random_code(length: int = 7) -> Column:
    """A random code of letters and digits for each row, of all rows' own: of 62 signs to a place."""
    return F.concat(*[F.substring(F.lit(CODE_SIGNS), 1, 62).substr((F.floor(F.rand() * 62) + 1).cast("int"), F.lit(1)) for _ in range(length)])
