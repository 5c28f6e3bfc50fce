"""PII surrogates.

Detected entities get keyed replacements of the same type and format. A replacement depends on
the key, the entity's type and its canonical form alone, so all mentions of an entity agree,
however they are written. Given and family names are entities of their own: a name after a title
is replaced part by part, and so are all its other mentions in the same text. A registry of all
distinct entities checks collisions: two entities never share a replacement, and no replacement
is an entity of the corpus; those that collide draw again.

Texts without any sign of an entity pass straight through. Of the others, one scan marks the
mentions; only rows that have mentions meet the registry's replacements in a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored, table, without

# Titles that announce a name and its gender, and name stems by gender and script.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madame", "Mme", "Mademoiselle", "Frau", "Señora", "Señorita", "Sra", "Госпожа"]
MALE_TITLES = ["Mr", "Sir", "Monsieur", "Herr", "Señor", "Sr", "Господин"]
OPEN_TITLES = ["Dr", "Prof", "Doctor", "Professor", "Κύριος", "Κυρία"]
NAMES = {
    ("female", "latin"): ["Adel", "Bert", "Clar", "Dian", "Elen", "Fann", "Gret", "Hann", "Iren", "Jul", "Klar", "Laur", "Mar", "Nad", "Olg", "Paul", "Ros", "Sar", "Tin", "Ver"],
    ("male", "latin"): ["Alb", "Brun", "Carl", "Dav", "Erik", "Fel", "Georg", "Hug", "Iv", "Jon", "Karl", "Leon", "Mart", "Nils", "Osc", "Paul", "Rob", "Sim", "Tom", "Vict"],
    ("any", "latin"): ["Arend", "Barl", "Cast", "Dorn", "Eber", "Fabr", "Garn", "Holm", "Ibarr", "Jans", "Kell", "Lind", "Mor", "Nord", "Ort", "Pet", "Quill", "Renn", "Sol", "Thorn"],
    ("female", "cyrillic"): ["Анн", "Вер", "Гал", "Дар", "Елен", "Ир", "Мар", "Нин", "Ольг", "Соф"],
    ("male", "cyrillic"): ["Ант", "Бор", "Викт", "Глеб", "Ден", "Ив", "Кир", "Макс", "Олег", "Пав"],
    ("any", "cyrillic"): ["Бел", "Волк", "Гром", "Орл", "Петр", "Сокол", "Тит", "Увар", "Чех", "Яш"],
    ("female", "greek"): ["Άνν", "Βέρ", "Ελέν", "Ζω", "Ηρώ", "Κάλι", "Μαρί", "Νίκ", "Ρέν", "Σοφί"],
    ("male", "greek"): ["Αλέξ", "Βασίλ", "Γιώργ", "Δημήτρ", "Κώστ", "Μάρκ", "Νίκ", "Πέτρ", "Στέφ", "Φίλιπ"],
    ("any", "greek"): ["Αργυρ", "Βλαχ", "Γεωργ", "Καραγ", "Λαμπρ", "Μακρ", "Παπαδ", "Ροδ", "Σταμ", "Χατζ"],
}
#: Consonants, vowels and endings that lengthen a stem to a name.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρτφχ", "αεηιο")}
ENDINGS = {("female", "latin"): "na", ("male", "latin"): "n", ("any", "latin"): "r", ("female", "cyrillic"): "на", ("male", "cyrillic"): "н", ("any", "cyrillic"): "в", ("female", "greek"): "να", ("male", "greek"): "ς", ("any", "greek"): "ς"}

# Detectors, in order of precedence. Repeats are bounded or possessive, so no text makes matching slow.
_BOUND = r"(?<![\p{L}\p{N}._%+\-])"
_KEYWORD = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key) {0,2}[=:] {0,2}[\"']?"


def _quoted(q: str) -> str:
    """A value of 6 characters or more after quote q, up to its last letter or digit before the closing quote on its line."""
    return rf"(?<={q})(?=(?:\\[^\n]|[^{q}\\\n]){{6,}}+{q})(?:(?:\\[^\n]|[^{q}\\\n\p{{L}}\p{{N}}])*+[\p{{L}}\p{{N}}]++)++"


#: Without closing quote a value goes up to white space, or a quote that ends a word; what is no letter or digit at its end stays.
_OPEN = r"(?=[^\s\"']{6})(?:(?:[^\s\"'\p{L}\p{N}]|[\"'](?=[\p{L}\p{N}]))*+[\p{L}\p{N}]++)++"
_HEX = "[0-9A-Fa-f]{1,4}"
_TITLES = FEMALE_TITLES + MALE_TITLES + OPEN_TITLES
#: White space after a title; one whole word of a name, with its apostrophes, hyphens and inner capitals; up to three of them.
_GAP = r"[ \u00a0]{1,3}"
_WORD = r"\p{Lu}[\p{L}\p{M}]{0,30}+(?:(?:-(?=\p{Lu})|['’](?!s(?!\p{L})))\p{L}[\p{L}\p{M}]{0,30}+){0,3}+(?!\p{L})"
_NAME = rf"{_WORD}(?: {_WORD}){{0,2}}"
PATTERNS = {
    "credential": "(?=[psatPSAT])" + _KEYWORD + "(?:" + _quoted('"') + "|" + _quoted("'") + "|" + _OPEN + ")",
    "email": _BOUND + r"[\p{L}\p{N}._%+\-]{1,64}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}[\p{L}\p{N}\-]{1,63}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]{{0,45}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?<=[0-9A-Fa-f])(?![\p{{L}}\p{{N}}:])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-f]*+\d)[0-9a-f]{32,}+(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:AKIA|ghp_|sk-)[A-Za-z0-9]{16,}+(?![A-Za-z0-9])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<![\d\-])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?![\d\-])",
    "phone": r"(?<![\d+(])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|(?<![.\-/])0\d{2,4} \d{3,4} \d{3,4})(?!\d)",
    "name": r"(?=\p{Lu})(?<=(?<!\p{L})(?:" + "|".join(t + r"\.?" + _GAP for t in _TITLES) + "))" + _NAME,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Kinds of given names in the registry; family names have the kind "name".
GIVEN = ["female given", "male given"]
_TITLED = "(?:" + "|".join(_TITLES) + r")\.?" + _GAP
#: Written around each mention; the escape keeps it out of texts that hold such characters.
_MARK, _ESCAPED = "\x01\x02", "\x01\x03"


def _either(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts)


def may_hold(text: Column) -> Column:
    """A cheap test that every text with an entity passes: what a detector can't do without."""
    stems = [t for t in _TITLES if not any(t != s and t.startswith(s) for s in _TITLES)]
    keyword = text.rlike(r"[=:](?<=(?i:password|passwd|pwd|secret|token|key) {0,2}[=:])")
    return F.coalesce(_either(text.rlike("[0-9@]"), keyword, *[F.contains(text, F.lit(x)) for x in ("AKIA", "ghp_", "sk-", *stems)]), F.lit(False))


def has_luhn(digits: Column) -> Column:
    """Whether the last digit of a string of digits is its check digit."""
    return _luhn(F.expr("substring(__digits, 1, length(__digits) - 1)")) == digits


def entity_type(raw: Column) -> Column:
    """The first detector whose shape the whole mention has (names are what no other claims)."""
    out = F.lit("name")
    shapes = {k: f"^(?:{p})$" for k, p in PATTERNS.items() if k != "name"} | {"credential": f"^{_KEYWORD}"}  # its quotes are not in the mention
    for kind, pattern in reversed(shapes.items()):
        out = F.when(raw.rlike(pattern), kind).otherwise(out)
    return F.when(raw.rlike(f"^{_KEYWORD}(?:{PATTERNS['secret']})$"), "secret").otherwise(out)  # with or without a keyword


def canonical(kind: Column, raw: Column) -> Column:
    """What all mentions of an entity have in common: numbers without separators, addresses in lower case, credentials without their keyword, names whatever their case."""
    bare = F.regexp_replace(raw, r"[^\p{L}\p{N}+]", "")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), bare).when(kind.isin("email", "ipv6"), F.lower(raw)).when(kind.isin("credential", "secret"), F.regexp_replace(raw, "^" + _KEYWORD, "")).when(kind.isin("name", *GIVEN), F.initcap(F.lower(raw))).otherwise(raw)


def _draw(stream: Column, i: Column, n: int) -> Column:
    """A number below n from byte i (from 1) of a hex stream, which is read around."""
    size = F.floor(F.length(stream) / 4).cast("int")
    at = (F.pmod(i - 1, size) * 4 + 1).cast("int")
    return F.pmod(F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int"), F.lit(n))


def _letters(stream: Column, text: Column, keep: int = 0) -> Column:
    """Each digit becomes a digit, each a-z or A-Z letter one of its case; the rest, and the first ``keep``, stay."""
    chars = F.split(text, "")
    chars = F.filter(chars, lambda c: c != "")

    def one(c: Column, i: Column) -> Column:
        lower = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (_draw(stream, i + 1, 26) + 1).cast("int"), F.lit(1))
        digit = _draw(stream, i + 1, 10).cast("string")
        other = F.when(c.rlike(r"^\p{Lu}$"), F.upper(lower)).when(c.rlike(r"^\p{L}$"), lower).otherwise(c)
        return F.when(i < keep, c).when(c.rlike(r"^[0-9]$"), digit).otherwise(other)

    return F.array_join(F.transform(chars, one), "")


def _luhn(body: Column) -> Column:
    """Digits followed by their check digit."""
    digits = F.reverse(F.filter(F.split(body, ""), lambda c: c != ""))
    parts = F.transform(digits, lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def _of(text: Column, stream: Column, at: Column | int, size: int) -> Column:
    """One character of ``text``, which has ``size``."""
    return F.substring(text, (_draw(stream, F.lit(at) if isinstance(at, int) else at, size) + 1).cast("int"), F.lit(1))


def _name(stream: Column, at: int, gender: str, script: str, attempt: Column) -> Column:
    """A stem, a syllable for the first and every later attempt, and the ending of the gender."""
    stems, (hard, soft) = NAMES[gender, script], SYLLABLES[script]
    stem = F.element_at(F.array(*[F.lit(n) for n in stems]), (_draw(stream, F.lit(at), len(stems)) + 1).cast("int"))
    syllables = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.concat(_of(F.lit(soft), stream, 2 * i + at + 1, len(soft)), _of(F.lit(hard), stream, 2 * i + at + 2, len(hard))))
    return F.concat(stem, F.array_join(syllables, ""), _of(F.lit(soft), stream, at + 30, len(soft)), F.lit(ENDINGS[gender, script]))


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits of an IBAN."""
    chars = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(chars, F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97)
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


#: The start of a phone number that stays: its country code, or the 0 of a number without one.
_COUNTRY = r"^(?:0|\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"


def streams(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` with what :func:`surrogate` draws from: keyed digests of the entity and of an address's domain."""
    seed = F.concat_ws("\x1f", F.lit(key), "kind", "canon", F.col("attempt").cast("string"))
    out = entities.withColumn("__stream", F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512)))
    out = out.withColumn("__host", F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), F.substring_index("canon", "@", -1)), 512))
    return out.withColumn("__canon", F.col("canon")).withColumn("__country", F.regexp_extract("canon", _COUNTRY, 0))


def surrogate(key: str, kind: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """The replacement's canonical form, drawn from the columns of :func:`streams`.

    email: another local part of the same shape (short ones get eight letters); addresses of one domain
    stay together below example.org. ip, ipv6: a valid address. card: the issuer digit stays and the check
    digit holds. phone: the country code stays. iban: the country stays and the check digits hold. ssn, secret:
    same shape, secrets keep their prefix. name: gender of the title, script of the name if that is Latin, Cyrillic
    or Greek (scripts without capitals are not found, others get Latin names); each later attempt adds a syllable.
    Phone and social security numbers of a format that is nearly used up get more digits.
    """
    stream, host = F.col("__stream"), F.col("__host")
    local = F.substring_index(canon, "@", 1)
    shaped = _letters(stream, F.when(F.length(local) >= 8, local).otherwise(F.rpad(local, 8, "x")))
    email = F.concat(shaped, F.lit("@"), _letters(host, F.lit("xxxxxxxx")), F.lit(".example.org"))
    octet = lambda i, lo, n: (_draw(stream, F.lit(i), n) + lo).cast("string")
    ip = F.concat_ws(".", octet(1, 1, 223), octet(2, 0, 256), octet(3, 0, 256), octet(4, 1, 254))
    card = _luhn(_letters(stream, F.expr("substring(__canon, 1, length(__canon) - 1)"), 1))
    country = F.regexp_extract(canon, _COUNTRY, 0)
    # a crowded format gets a digit more for every attempt after the third
    wider = F.substring(F.lit("0000000000000000000000000000000000000000"), F.lit(1), F.greatest(attempt - NARROW, F.lit(0)))
    phone = F.concat(country, _letters(stream, F.concat(F.expr("substring(__canon, length(__country) + 1)"), wider)))
    land, body = F.substring(canon, 1, 2), _letters(stream, F.expr("substring(__canon, 5)"))
    iban = F.concat(land, _iban_check(land, body), body)
    hexes = lambda start: F.transform(F.filter(F.split(canon, ""), lambda c: c != ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.lower(F.hex(_draw(stream, i + 1, 16 - start) + start))).otherwise(c))
    hexed, ipv6 = F.array_join(hexes(0), ""), F.array_join(hexes(1), "")
    secret = F.when(canon.rlike(r"^[0-9a-f]+$"), hexed).when(canon.rlike("^(AKIA|ghp_|sk-)"), _letters(stream, canon, 4)).otherwise(_letters(stream, canon))
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    greek = canon.rlike(r"\p{IsGreek}")
    made_name = lambda g: F.when(cyrillic, _name(stream, 1, g, "cyrillic", attempt)).when(greek, _name(stream, 1, g, "greek", attempt)).otherwise(_name(stream, 1, g, "latin", attempt))
    name = F.when(kind == GIVEN[0], made_name("female")).when(kind == GIVEN[1], made_name("male")).otherwise(made_name("any"))
    made = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "card", card).when(kind == "phone", phone)
    return made.when(kind.isin("secret", "credential"), secret).when(kind == "iban", iban).when(kind.isin("name", *GIVEN), name).otherwise(_letters(stream, F.concat(canon, wider)))


def in_format(kind: Column, raw: Column, core: Column) -> Column:
    """The canonical replacement written as the mention was: its separators and its case stay."""
    chars = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    bare = chars(core)
    shape = chars(F.when(kind.isin("card", "phone", "ssn", "iban"), raw).otherwise(""))  # others may be long
    counts = F.transform(shape, lambda c, i: F.size(F.filter(F.slice(shape, F.lit(1), i + 1), lambda x: x.rlike(r"[\p{L}\p{N}+]"))))
    dressed = F.array_join(F.zip_with(shape, counts, lambda c, n: F.when(c.rlike(r"[\p{L}\p{N}+]"), F.coalesce(F.get(bare, n - 1), F.lit(""))).otherwise(c)), "")
    dressed = F.concat(dressed, F.array_join(F.slice(bare, F.coalesce(F.array_max(counts), F.lit(0)) + 1, F.size(bare)), ""))  # a widened format's last digits
    named = F.concat(F.regexp_extract(raw, "^" + _KEYWORD, 0), core)
    upper = chars(F.when(kind == "email", F.substring_index(raw, "@", 1)).otherwise(""))
    cased = F.array_join(F.transform(bare, lambda c, i: F.when(F.coalesce(F.get(upper, i).rlike(r"\p{Lu}"), F.lit(False)), F.upper(c)).otherwise(c)), "")
    email = F.when(raw == F.lower(raw), core).when(raw == F.upper(raw), F.upper(core)).otherwise(cased)
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), dressed).when(kind.isin("credential", "secret"), named).when(kind == "email", email)
        .when((kind == "ipv6") & raw.rlike("[A-F]"), F.upper(core)).when(kind.isin("name", *GIVEN) & (F.length(raw) > 1) & (raw == F.upper(raw)), F.upper(core)).otherwise(core)
    )


#: Attempts before a format is widened.
NARROW = 3


def registry(entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """``(kind, canon, core)`` for distinct entities: no two of a kind share a core, and no core is an entity.

    ``entities`` has (kind, canon, gender). Those that collide with an entity, with a core of an
    earlier round or with another draw of this one draw again, the others are settled; of equal
    draws the smallest canonical form keeps its own. Formats widen after some attempts, so the
    rows of a round soon come to none.
    """
    left = stored(entities.groupBy("kind", "canon").agg(F.max("gender").alias("gender")), "entities")
    taken = left.select(F.col("kind").alias("k"), F.col("canon").alias("taken"))
    settled: list[DataFrame] = []
    for attempt in range(rounds):
        core = surrogate(key, F.col("kind"), F.col("canon"), F.col("gender"), F.col("attempt"))
        drawn = stored(streams(left.withColumn("attempt", F.lit(attempt)), key).withColumn("core", core).select("kind", "canon", "gender", "core"), "drawn")
        # written first, so that the joins can split a core that very many entities drew
        keeps = stored(drawn.groupBy("kind", "core").agg(F.min("canon").alias("keeper")), "keeps")
        used = reduce(DataFrame.unionAll, [taken, *[s.select("kind", "core") for s in settled]]).toDF("k", "taken")
        checked = drawn.join(keeps.hint("merge"), ["kind", "core"]).join(used.hint("merge"), F.expr("kind = k and core = taken"), "left")
        checked = stored(checked.select("kind", "canon", "gender", "core", ((F.col("keeper") != F.col("canon")) | F.col("taken").isNotNull()).alias("again")), "checked")
        settled.append(checked.filter("not again").select("kind", "canon", "core"))
        discard(drawn, keeps)
        left = checked.filter("again").select("kind", "canon", "gender")
        if not left.limit(1).count():
            return reduce(DataFrame.unionAll, settled)
    raise RuntimeError(f"replacements still collide after {rounds} rounds")


def _any(words: Column) -> Column:
    """The pattern of a text's entities: what the detectors find, and other mentions of the words of its names."""
    one = F.concat(F.lit("(?:"), F.array_join(words, "|"), F.lit(")"))
    return F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])"), one, F.lit("(?: "), one, F.lit(r"){0,2}(?![\p{L}\p{N}])"))


def _pieces(text: Column, pattern: Column) -> Column:
    """The text in pieces: between mentions (even places) and the mentions (odd places), by one scan."""
    marked = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit(_ESCAPED)), pattern, F.lit(_MARK + "$0" + _MARK))
    return F.transform(F.split(marked, _MARK, -1), lambda p: F.replace(p, F.lit(_ESCAPED), F.lit("\x01")))


def _mentions(pieces: Column) -> Column:
    return F.filter(pieces, lambda _, i: i % 2 == 1)


def marked_rows(rows: DataFrame, text_col: str) -> DataFrame:
    """``(row, key, pieces, titled, words, given)`` of rows that may hold an entity; ``row`` has the columns but the text."""
    text = F.col(f"`{text_col}`")
    others = [F.col(f"`{c}`") for c in rows.columns if c != text_col]
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    titled = F.regexp_extract_all(text, F.lit(r"(?<!\p{L})" + _TITLED + _NAME), F.lit(0))
    out = rows.select(row.alias("row"), text.alias("text"), F.md5(text.cast("binary")).alias("key"), _pieces(text, F.lit(ANY)).alias("pieces"), titled.alias("titled"))
    named = F.array_intersect(_mentions(F.col("pieces")), F.transform("titled", lambda t: F.regexp_replace(t, "^" + _TITLED, "")))
    out = out.withColumn("named", named)
    # full names say which words are given and which family names
    full = F.transform(F.filter("named", lambda x: F.instr(x, " ") > 0), lambda x: F.split(x, " "))
    words = F.flatten(F.transform("named", lambda x: F.split(x, " ")))
    plain = lambda x: F.initcap(F.lower(x))
    # a word counts as it stands, in capitals, and where it stands in capitals also with one alone
    words = F.array_distinct(F.concat(words, F.transform(words, F.upper), F.transform(F.filter(words, lambda x: x == F.upper(x)), plain)))
    out = out.withColumn("words", words).withColumn("given", F.array_except(F.transform(full, lambda x: plain(x[0])), F.transform(full, lambda x: plain(x[1]))))
    pieces = F.when(F.size("words") > 0, _pieces(F.col("text"), _any(F.col("words")))).otherwise(F.col("pieces"))
    return out.select("row", "key", pieces.alias("pieces"), "titled", "words", "given")


def mentions_of(marked: DataFrame) -> DataFrame:
    """``(key, pos, part, type, raw, kind, canon, gender)``: all mentions of each distinct text, names by their parts.

    A number of a card's shape without its check digit has the type ``other`` and stays.
    """
    texts = marked.filter(F.size("pieces") > 1).select("key", _mentions(F.col("pieces")).alias("raws"), "titled", "words", "given").dropDuplicates(["key"])
    rows = texts.select("key", "titled", "words", "given", F.posexplode("raws").alias("pos", "raw")).withColumn("__digits", F.regexp_replace("raw", "[^0-9]", ""))
    kind = entity_type(F.col("raw"))
    rows = rows.withColumn("type", kind)
    rows = rows.withColumn("type", F.when((F.col("type") == "card") & ~has_luhn(F.col("__digits")), "other").otherwise(F.col("type")))
    female = F.exists("titled", lambda t: F.array_contains(F.split(F.lower(t), "[ \u00a0]"), F.lower("raw")) & t.rlike("^(?:" + "|".join(FEMALE_TITLES) + r")\.?" + _GAP))
    parts = F.when(F.col("type") == "name", F.split("raw", " ")).otherwise(F.array("raw"))
    rows = rows.select("key", "pos", "type", "titled", "words", "given", F.size(parts).alias("n_parts"), F.posexplode(parts).alias("part", "raw"))
    rows = rows.withColumn("gender", F.when((F.col("type") == "name") & female, "female").otherwise("male"))
    first = F.when(F.col("n_parts") > 1, F.col("part") == 0).otherwise(F.array_contains("given", F.initcap(F.lower("raw"))))
    rows = rows.withColumn("kind", F.when((F.col("type") == "name") & first, F.concat("gender", F.lit(" given"))).otherwise(F.col("type"))).withColumn("canon", canonical(F.col("kind"), F.col("raw")))
    return rows.select("key", "pos", "part", "type", "raw", "kind", "canon", "gender")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's entities replaced, plus ``n_entities`` and ``entity_types`` (in order).

    Null text stays null and has none, empty text stays empty; other columns pass through, input
    columns named like a computed one are replaced; repeated rows are replaced alike, and so are
    equal texts of different ids. Texts of any length are scanned whole.
    """
    kept = without(docs, ["n_entities", "entity_types"])
    text = F.col(f"`{text_col}`")
    none = [F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("entity_types")]
    untouched = kept.filter(~may_hold(text)).select("*", *none)
    marked = stored(marked_rows(kept.filter(may_hold(text)), text_col), "marked")
    mentions = stored(mentions_of(marked), "mentions")
    cores = registry(mentions.filter("type <> 'other'").select("kind", "canon", "gender"), key)
    placed = mentions.join(cores, ["kind", "canon"], "left").select("key", "pos", "part", "type", F.when(F.col("type") == "other", F.col("raw")).otherwise(in_format(F.col("kind"), F.col("raw"), F.col("core"))).alias("new"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]), " ")
    placed = placed.groupBy("key", "pos").agg(F.first("type").alias("kind"), whole.alias("new"))
    # written first, so that the join can split the rows of a text with very many copies
    lists = stored(placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "new"))).alias("all")), "replacements")
    woven = F.array_join(F.transform("pieces", lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get(F.col("all"), (i / 2).cast("int"))["new"])), "")
    types = F.filter(F.transform("all", lambda x: x["kind"]), lambda k: k != "other")
    own = lambda value: [value.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept.columns]
    clear = marked.filter(F.size("pieces") == 1).select(*own(F.col("pieces")[0]), *none)
    joined = marked.filter(F.size("pieces") > 1).join(lists.hint("merge"), "key")
    replaced = joined.select(*own(woven), F.size(types).cast("long").alias("n_entities"), types.alias("entity_types"))
    return untouched.unionByName(clear).unionByName(replaced)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with its entities replaced."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key="tidemark")
