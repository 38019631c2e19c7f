"""Personal data replaced by consistent surrogates, in DataFrame operations only.

Detected: e-mail addresses, phone numbers, card and account numbers, US social security numbers, IPv4
addresses, IBANs, secrets (long hex strings and known key prefixes), and names after a form of address.
Each entity gets a surrogate drawn from a keyed hash:

* type and format stay: digits for digits with the same separators, a valid Luhn digit for a valid one, the
  country code of a phone, the top-level domain of an address, octets in range;
* names keep gender (from the form of address), script (Latin, Cyrillic, Greek) and capitals; initials are letters
  for letters, particles ("von", "de la") stay;
* the same entity has the same surrogate in all documents, whatever its layout: "+1 (017) 555-7713" and
  "+1 017 555 7713" are one phone, "Mr. Smith" and "Mr. John Smith" share a surname;
* different entities have different surrogates. Draws are checked against each other and against all real
  values, and the losers draw again. Where the real values of a format of fixed length fill a large part of it,
  its free values are dealt by rank instead; only when these are used up does an entity get the real value of
  another one.

The dictionary of entities is a distributed table, as it grows with the corpus. A document looks up its own
entities only, and only documents that have some are shuffled.

Defined results: null and empty texts stay as they are, with no entities; repeated rows are rewritten alike;
an empty table gives an empty table; all columns but `text` pass through, and an input column `n_entities`
is replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage
from .text import packed

KEY = "tradewind"
# A format is crowded, and its values are dealt instead of drawn, if 1 / CROWDED of them are real. In all others
# at least every second draw is free, so the rounds end; this many without any winner would be an error.
CROWDED = 5
MAX_IDLE = 64
# Values of a crowded format are listed in blocks of this many.
BLOCK = 1 << 16

MALE = ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Sir", "Г-н", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Madam", "Г-жа", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Mx"]
_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
# Words in lower case before a surname; they stay, as they tell no one apart. Some are articles or prepositions that may
# stand behind a whole name, so they count only right behind the form of address or another such word.
_LINKS = "von und zu|von|van|vom|de|del|della|dello|degli|dei|di|da|do|dos|du|la|el|al|bin|bint|ibn|ben|abu|af|av|ap|y|e|ter|фон|ван|де|да|ибн"
_ARTICLES = "der|den|dem|des|das|las|le|les|los|lo|het|zu|zum|zur|auf|vor|ten|te|i|дер|цу"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# One or more forms of address, as in "Herr Prof. Dr."; a word, initials with or without one behind, or a bare initial.
_ADDRESS = rf"(?:{_TITLES})(?:\.? (?:{_TITLES})(?![\p{{L}}'’\-]))*"
_NAME_WORD = r"(?:[dDlL]['’])?\p{Lu}[\p{L}'’\-]+"
_NAME_PART = rf"(?!(?:{_TITLES})(?![\p{{L}}'’\-]))(?:(?:\p{{Lu}}\.-?)+(?:{_NAME_WORD})?|{_NAME_WORD}|\p{{Lu}}(?= \p{{L}}|{_NO_WORD_AFTER}))"
PATTERNS = {
    "EMAIL": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}",
    "SECRET": _NO_WORD_BEFORE + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}"
    r"|sk-[A-Za-z0-9]{20,64})" + _NO_WORD_AFTER,
    "IBAN": _NO_WORD_BEFORE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _NO_WORD_AFTER,
    "SSN": r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "IP": r"(?<![\p{L}\p{N}.])" + rf"{_OCTET}(?:\.{_OCTET}){{3}}" + r"(?![\p{L}\p{N}]|\.\d)",
    "CARD": _NO_WORD_BEFORE + r"(?:\d{13,19}|\d{4}([ \-])(?:\d{4}\1\d{4}\1\d{1,7}|\d{6}\1\d{4,5}))" + _NO_WORD_AFTER,
    "PHONE": r"(?:(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){1,4}"
    r"|(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4})" + _NO_WORD_AFTER,
    "NAME": _NO_WORD_BEFORE + rf"{_ADDRESS}\.?(?: (?:{_ARTICLES}))*(?: (?:(?:{_LINKS}) (?:(?:{_ARTICLES}) )*)*{_NAME_PART})+",
}
ANY = "|".join(f"(?:{pattern})" for pattern in PATTERNS.values())
# No pattern matches without one of these; most documents are done with one cheap look.
_MAYBE = rf"[0-9@]|{_NO_WORD_BEFORE}(?:{_TITLES})\.? \p{{L}}|sk-[A-Za-z]|gh[pousr]_[A-Za-z]|AKIA[A-Z]|[a-f]{{32}}|[A-F]{{32}}"

# Parts of invented names by script; (male, female, neutral) endings of given names.
SYLLABLES = {
    "latin": ["bar", "cel", "dan", "fer", "gal", "hol", "jin", "kel", "lom", "mir", "nor", "pel", "ras", "sol", "tam", "vin"],
    "cyrillic": ["бор", "вел", "гар", "дам", "жел", "зор", "кир", "лад", "мир", "нев", "пол", "рад", "сав", "тим", "фед", "яр"],
    "greek": ["αλ", "βερ", "γαρ", "δημ", "ζαν", "θεο", "καλ", "λαμ", "μαρ", "νικ", "παν", "ρος", "σαμ", "ταλ", "φιλ", "χαρ"],
}
ENDINGS = {
    "latin": ("us", "ina", "ey"),
    "cyrillic": ("ан", "ина", "ей"),
    "greek": ("ος", "ινα", "ης"),
}


# --- entities of a match ------------------------------------------------------------


def _has_entities(text: Column) -> Column:
    return F.when(text.rlike(_MAYBE), text.rlike(ANY)).otherwise(F.lit(False))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _piece(kind, norm: Column, shape: Column) -> Column:
    kind = F.lit(kind).cast("string") if not isinstance(kind, Column) else kind
    return F.struct(kind.alias("kind"), norm.alias("norm"), shape.alias("shape"))


def _name_pieces(match: Column) -> Column:
    """Forms of address and particles as they are, given names by gender, initials, the last word as surname."""
    title = F.regexp_extract(match, rf"^({_TITLES})", 1)
    gender = F.when(title.isin(MALE), "GIVEN_M").when(title.isin(FEMALE), "GIVEN_F").otherwise("GIVEN_N")
    token = F.lit(r"\p{L}[\p{L}'’\-]*|[^\p{L}]+")
    tokens = F.regexp_extract_all(match, token, F.lit(0))
    titles = F.size(F.regexp_extract_all(F.regexp_extract(match, rf"^{_ADDRESS}", 0), token, F.lit(0)))

    def own(part, i):
        return (i >= titles) & part.rlike(r"^(?:\p{Lu}|[dl]['’])")

    # An initial is one letter, with the hyphen of a double one or without.
    last = F.array_max(F.transform(tokens, lambda part, i: F.when(own(part, i) & part.rlike(r"^\p{L}[\p{L}'’\-]*\p{L}"), i).otherwise(-1)))

    def piece(part, i):
        word = F.when(i == last, "SURNAME").otherwise(gender)
        kind = F.when(own(part, i), F.when(part.rlike(r"^\p{L}[\-'’]*$"), "INITIAL").otherwise(word))
        return _piece(kind, F.when(kind.isNotNull(), F.lower(part)), part)

    return F.transform(tokens, piece)


def _pieces(match: Column) -> Column:
    """A match as pieces in order: those with a kind are entities, the others stay."""
    code = F.regexp_extract(match, r"^\+(\d{1,3})(?=[ .(\-])", 1)
    number = F.concat(code, F.lit("|"), F.substr(_digits(match), F.length(code) + 1))
    return (
        F.when(match.contains("@"), F.array(_piece("EMAIL", F.lower(match), match)))
        .when(match.rlike(r"^(?:[0-9a-fA-F]{32,}|AKIA|gh[pousr]_|sk-)"), F.array(_piece("SECRET", match, match)))
        .when(match.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]"), F.array(_piece("IBAN", F.replace(match, F.lit(" "), F.lit("")), match)))
        .when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.array(_piece("SSN", _digits(match), match)))
        .when(match.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.array(_piece("IP", match, match)))
        .when(match.rlike(r"^\p{L}"), _name_pieces(match))
        .when(match.rlike(r"^\d[\d \-]*$") & (F.length(_digits(match)) >= 13), F.array(_piece("CARD", _digits(match), match)))
        .otherwise(F.array(_piece("PHONE", number, match)))
    )


def _matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


# --- surrogates ----------------------------------------------------------------------


def _draw(kind: Column, norm: Column, attempt: Column, key: str, salt: str = "") -> Column:
    """64 hex digits that depend on the key, the entity and the attempt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(salt), kind, norm, attempt.cast("string")), 256)


def _byte(digest: Column, i) -> Column:
    """The i-th byte of a digest; positions go round after 32."""
    at = (F.lit(i) if isinstance(i, int) else i) % 32
    return F.conv(F.substr(digest, (2 * at + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, number: Column) -> Column:
    return F.substr(F.lit(alphabet), (number % len(alphabet) + 1).cast("int"), F.lit(1))


_CLASSES = [
    (r"[0-9]", "0123456789"),
    (r"[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    (r"[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[α-ωά-ώ]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{L}\p{N}]", "abcdefghijklmnopqrstuvwxyz"),
]


def _like(value: Column, digest: Column) -> Column:
    """The value with every letter and digit replaced by one of its class."""

    def swap(char, i):
        # Far positions mix in their round, so that long values do not repeat themselves.
        number = _byte(digest, i) + (i / 32).cast("int") * 7
        chosen = F.when(F.lit(False), char)
        for pattern, alphabet in _CLASSES:
            chosen = chosen.when(char.rlike(f"^{pattern}$"), _letter(alphabet, number))
        return chosen.otherwise(char)

    return F.array_join(F.transform(F.split(value, ""), swap), "")


def _hex_like(value: Column, digest: Column) -> Column:
    wide = F.substr(F.concat(digest, F.sha2(digest, 256)), F.lit(1), F.length(value))
    return F.when(value == F.upper(value), F.upper(wide)).otherwise(wide)


def _luhn_sum(digits: Column, extra: int) -> Column:
    """Luhn sum of a digit string that `extra` further digits follow."""
    doubled = (F.length(digits) + extra) % 2

    def value(char, i):
        number = char.cast("int")
        twice = number * 2
        return F.when(i % 2 == doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(number)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda total, x: total + x)


def _card_like(norm: Column, digest: Column) -> Column:
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), F.substr(_like(norm, digest), F.lit(2), F.length(norm) - 2))
    check = ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")
    # An invalid number stays invalid, so that both kinds of card have values of their own.
    other = ((check.cast("int") + 1 + _byte(digest, 31) % 9) % 10).cast("string")
    return F.concat(body, F.when(_luhn_sum(norm, 0) % 10 == 0, check).otherwise(other))


def _email_like(norm: Column, digest: Column, attempt: Column, key: str) -> Column:
    """A local part like the own one, in a domain that depends on the real domain only."""
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    top = F.substring_index(domain, ".", -1)
    below = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    company = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain), 256)
    # Short local parts run out of distinct values; later draws get longer.
    more = F.substr(F.translate(F.reverse(digest), "0123456789", "ghijklmnop"), F.lit(1), (attempt / 4).cast("int"))
    return F.concat(_like(local, digest), more, F.lit("@"), _like(below, company), F.lit("."), top)


def _ip_like(digest: Column) -> Column:
    octets = [(_byte(digest, 0) % 223 + 1), _byte(digest, 1), _byte(digest, 2), (_byte(digest, 3) % 254 + 1)]
    return F.concat_ws(".", *[octet.cast("string") for octet in octets])


def _phone_like(norm: Column, digest: Column) -> Column:
    code, rest = F.substring_index(norm, "|", 1), F.substring_index(norm, "|", -1)
    digits = _like(rest, digest)
    first = (_byte(digest, 31) % 8 + 2).cast("string")
    return F.concat(code, F.lit("|"), first, F.substr(digits, F.lit(2), F.length(rest)))


def _name_like(norm: Column, digest: Column, attempt: Column, gender: int | None) -> Column:
    """An invented name in the script of the real one; later draws get longer."""

    def in_script(script: str) -> Column:
        syllables = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        parts = F.sequence(F.lit(0), F.lit(1 if gender is not None else 2) + (attempt / 4).cast("int"))
        stem = F.array_join(F.transform(parts, lambda i: F.get(syllables, _byte(digest, i) % 16)), "")
        return stem if gender is None else F.concat(stem, F.lit(ENDINGS[script][gender]))

    cyrillic, greek = norm.rlike(r"\p{IsCyrillic}"), norm.rlike(r"\p{IsGreek}")
    return F.when(cyrillic, in_script("cyrillic")).when(greek, in_script("greek")).otherwise(in_script("latin"))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate, in normal form, that an entity draws at an attempt."""
    digest = _draw(kind, norm, attempt, key)
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.substr(_like(norm, digest), F.lit(3), F.length(norm)))
    secret = F.when(norm.rlike("^[0-9a-fA-F]{32,}$"), _hex_like(norm, digest)).otherwise(
        F.concat(F.substr(norm, F.lit(1), F.lit(4)), F.substr(_like(norm, digest), F.lit(5), F.length(norm)))
    )
    return (
        F.when(kind == "EMAIL", _email_like(norm, digest, attempt, key))
        .when(kind == "PHONE", _phone_like(norm, digest))
        .when(kind == "CARD", _card_like(norm, digest))
        .when(kind.isin("SSN", "INITIAL"), _like(norm, digest))
        .when(kind == "IP", _ip_like(digest))
        .when(kind == "IBAN", iban)
        .when(kind == "SECRET", secret)
        .when(kind == "GIVEN_M", _name_like(norm, digest, attempt, 0))
        .when(kind == "GIVEN_F", _name_like(norm, digest, attempt, 1))
        .when(kind == "GIVEN_N", _name_like(norm, digest, attempt, 2))
        .otherwise(_name_like(norm, digest, attempt, None))
    )


# --- formats of a fixed length -------------------------------------------------------


def _format(kind: Column, norm: Column) -> Column:
    """What a surrogate keeps of a value of fixed length; null for kinds whose later draws get longer or are long."""
    phone = F.concat(F.substring_index(norm, "|", 1), F.lit("|"), F.length(F.substring_index(norm, "|", -1)).cast("string"))
    valid = F.when(_luhn_sum(norm, 0) % 10 == 0, "valid").otherwise("other")
    card = F.concat_ws("|", F.length(norm).cast("string"), F.substr(norm, F.lit(1), F.lit(1)), valid)
    script = F.when(norm.rlike("[а-яё]"), "cyrillic").when(norm.rlike("[α-ωά-ώ]"), "greek").otherwise("latin")
    initial = F.concat(script, F.regexp_replace(norm, r"^\p{L}", "|"))
    fixed = F.when(kind == "PHONE", phone).when(kind == "CARD", card).when(kind == "INITIAL", initial)
    return fixed.when(kind.isin("SSN", "IP"), F.lit(""))


def _alphabet(form: Column) -> Column:
    alphabets = dict(_CLASSES)
    by_script = F.when(form.startswith("cyrillic"), alphabets[r"[а-яё]"]).when(form.startswith("greek"), alphabets[r"[α-ωά-ώ]"])
    return by_script.otherwise(alphabets[r"[a-z]"])


def _space(kind: Column, form: Column) -> Column:
    """How many values a format has, as a double."""
    card = F.pow(F.lit(10.0), F.substring_index(form, "|", 1).try_cast("double") - 2)
    return (
        F.when(kind == "PHONE", F.pow(F.lit(10.0), F.substring_index(form, "|", -1).try_cast("double")))
        .when(kind == "CARD", F.when(form.endswith("valid"), card).otherwise(9 * card))
        .when(kind == "INITIAL", F.length(_alphabet(form)).cast("double"))
        .when(kind == "SSN", F.lit(1e9))
        .otherwise(F.lit(223.0 * 256 * 256 * 254))
    )


def _value_at(kind: Column, form: Column, i: Column) -> Column:
    """The i-th value of a format, in normal form."""

    def digits(number: Column, length: Column) -> Column:
        return F.substr(F.concat(F.repeat(F.lit("0"), length), number.cast("string")), -length)

    def length(at: int) -> Column:
        return F.substring_index(form, "|", at).try_cast("int")

    phone = F.concat(F.substring_index(form, "|", 1), F.lit("|"), digits(i, length(-1)))
    size = length(1)
    first = F.substring_index(F.substring_index(form, "|", 2), "|", -1)
    valid = form.endswith("valid")
    body = F.concat(first, digits(F.when(valid, i).otherwise(F.floor(i / 9).cast("bigint")), size - 2))
    check = (10 - _luhn_sum(body, 1) % 10) % 10
    card = F.concat(body, F.when(valid, check).otherwise((check + 1 + i % 9) % 10).cast("string"))
    octets = [F.floor(i / (256 * 256 * 254)) % 223 + 1, F.floor(i / (256 * 254)) % 256, F.floor(i / 254) % 256, i % 254 + 1]
    ip = F.concat_ws(".", *[octet.cast("bigint").cast("string") for octet in octets])
    letter = F.concat(F.substr(_alphabet(form), (i + 1).cast("int"), F.lit(1)), F.substring_index(form, "|", -1))
    fixed = F.when(kind == "PHONE", phone).when(kind == "CARD", card).when(kind == "INITIAL", letter)
    return fixed.when(kind == "SSN", digits(i, F.lit(9))).otherwise(ip)


def _ranked(values: DataFrame, key: str) -> DataFrame:
    """`values` (kind, _format, norm) with their keyed rank in the format from 0 in `_rank`, and its size in `_n`.

    Ranked in two steps, by hash buckets and within a bucket, as a format may hold most of the entities.
    """
    group = ["kind", "_format"]
    values = cut_lineage(values.withColumn("_draw", _draw(F.col("kind"), F.col("norm"), F.lit(0), key, "rank")))
    # As many rows as there are crowded formats, which their codes and lengths bound.
    values = values.join(F.broadcast(values.groupBy(*group).agg(F.count("*").alias("_n"))), group)
    start = F.conv(F.substr("_draw", F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    values = values.withColumn("_bucket", start % F.ceil(F.sqrt("_n")).cast("bigint"))
    sizes = values.groupBy(*group, "_bucket").agg(F.count("*").alias("_c"))
    until = F.sum("_c").over(Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    values = values.join(sizes.withColumn("_before", until - F.col("_c")).drop("_c"), [*group, "_bucket"])
    own = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_draw", "norm"))
    return values.select(*group, "norm", "_n", (F.col("_before") + own - 1).alias("_rank"))


def _dealt(crowded: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of the entities (kind, _format, norm) of crowded formats (kind, _format, _space).

    By rank, entities get the values that are not real. Those left over pass their real values round.
    """
    group = ["kind", "_format"]
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.col("_space").cast("bigint") - 1
    blocks = crowded.select(*group, last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / BLOCK))).alias("_b"))
    first = F.col("_b") * BLOCK
    numbers = F.explode(F.sequence(first, F.least(F.col("_last"), first + (BLOCK - 1)))).alias("_i")
    listed = blocks.repartition(tasks, *group, "_b").select(*group, numbers)
    listed = listed.select(*group, _value_at(F.col("kind"), F.col("_format"), F.col("_i")).alias("norm"))
    free = _ranked(listed.join(entities.select("kind", "norm"), ["kind", "norm"], "left_anti"), key)
    own = cut_lineage(_ranked(entities, key))
    free = cut_lineage(free.select(*group, "_rank", F.col("norm").alias("surrogate"), F.col("_n").alias("_free")))
    counts = F.broadcast(free.groupBy(*group).agg(F.max("_free").alias("_free")))
    got = own.join(free.drop("_free"), [*group, "_rank"])
    rest = own.join(counts, group, "left").withColumn("_free", F.coalesce("_free", F.lit(0))).where("_rank >= _free")
    following = F.when(F.col("_rank") < F.col("_n") - 1, F.col("_rank") + 1)
    following = following.when(F.col("_n") - F.col("_free") > 1, F.col("_free")).otherwise(0)
    passed = own.select(*group, "_rank", F.col("norm").alias("surrogate"))
    passed = rest.withColumn("_rank", following).join(passed, [*group, "_rank"])
    columns = ["kind", "norm", "surrogate"]
    return cut_lineage(got.select(*columns).union(passed.select(*columns)))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, surrogate) of distinct entities (kind, norm); surrogates of a kind are distinct.

    Every round the open entities draw. Of those that draw the same, the smallest wins; a draw that is
    taken or real loses. Losers draw again. Entities of crowded formats are dealt their surrogates before.
    """
    # A draw costs far more than its bytes suggest, so the number of tasks is set rather than left to their size.
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending, taken = cut_lineage(entities.repartition(tasks, "kind", "norm")), None
    real = pending.select("kind", F.col("norm").alias("surrogate"))
    formed = pending.withColumn("_format", _format(F.col("kind"), F.col("norm")))
    crowded = formed.where("_format is not null").groupBy("kind", "_format").agg(F.count("*").alias("n"))
    crowded = crowded.withColumn("_space", _space(F.col("kind"), F.col("_format"))).where(F.col("n") * CROWDED > F.col("_space"))
    crowded = cut_lineage(crowded.select("kind", "_format", "_space"))
    if not crowded.isEmpty():
        group, few = ["kind", "_format"], F.broadcast(crowded)
        taken = _dealt(crowded, formed.join(few, group, "left_semi").select("kind", "_format", "norm"), key)
        pending = cut_lineage(formed.join(few, group, "left_anti").select("kind", "norm"))
    attempt = idle = 0
    while taken is None or not pending.isEmpty():
        drawn = surrogate(F.col("kind"), F.col("norm"), F.lit(attempt), key)
        drawn = pending.select("kind", "norm", drawn.alias("surrogate")).where("norm != surrogate")
        drawn = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            drawn = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = cut_lineage(drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm")).select("kind", "norm", "surrogate"))
        taken = won if taken is None else taken.union(won)
        pending = cut_lineage(pending.join(won, ["kind", "norm"], "left_anti"))
        attempt, idle = attempt + 1, idle + 1 if won.isEmpty() else 0
        if idle == MAX_IDLE:
            raise RuntimeError(f"no surrogate was free in {MAX_IDLE} rounds")
    return taken


def _pour(shape: Column, kind: Column, value: Column) -> Column:
    """A surrogate in the layout of the text it replaces."""
    digits = _digits(value)

    def digit(char, i):
        before = F.length(_digits(F.substr(shape, F.lit(1), i)))
        return F.when(char.rlike("^[0-9]$"), F.substr(digits, before + 1, F.lit(1))).otherwise(char)

    def grouped(char, i):
        before = F.length(F.replace(F.substr(shape, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(char == " ", char).otherwise(F.substr(value, before + 1, F.lit(1)))

    laid = F.array_join(F.transform(F.split(shape, ""), digit), "")
    name = F.when(shape == F.upper(shape), F.upper(value)).otherwise(F.initcap(value))
    return (
        F.when(kind.isin("PHONE", "CARD", "SSN"), laid)
        .when(kind == "IBAN", F.array_join(F.transform(F.split(shape, ""), grouped), ""))
        .when(kind.isin("IP", "SECRET"), value)
        .when(kind == "EMAIL", F.when((shape == F.upper(shape)) & (shape != F.lower(shape)), F.upper(value)).otherwise(value))
        .otherwise(name)
    )


# --- the operator ----------------------------------------------------------------------


def _label(kind: Column, norm: Column) -> Column:
    return F.concat(kind, F.lit(":"), norm)


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """`docs` with surrogates in `text` and the number of entities in `n_entities`."""
    rows = docs.select(packed(docs, ["text", "n_entities"]), "text")
    columns = ["_row.*", "text", "n_entities"]
    clean = rows.where(~F.coalesce(_has_entities(F.col("text")), F.lit(False)))
    clean = clean.withColumn("n_entities", F.lit(0).cast("bigint"))

    dirty = rows.where(_has_entities(F.col("text"))).withColumn("_key", F.sha2("text", 256))
    pieces = F.flatten(F.transform(_matches(F.col("text")), _pieces))
    found = docs.where(_has_entities(F.col("text"))).select(F.sha2("text", 256).alias("_key"), F.explode(pieces).alias("p"))
    found = found.where("p.kind is not null").select("_key", "p.kind", "p.norm")
    # Copies of a text and repetitions within it collapse before anything is joined.
    found = cut_lineage(found.distinct())
    dictionary = assign(found.select("kind", "norm").distinct(), key)
    entry = F.struct(_label(F.col("kind"), F.col("norm")).alias("label"), F.col("surrogate"))
    lists = found.join(dictionary, ["kind", "norm"]).groupBy("_key").agg(F.map_from_entries(F.collect_list(entry)).alias("_map"))
    # Stored, so that the join below deals both sides anew and can split a text with very many copies.
    dirty = dirty.join(cut_lineage(lists), "_key")

    def rewritten(match):
        def part(piece):
            value = F.col("_map")[_label(piece["kind"], piece["norm"])]
            return F.when(piece["kind"].isNull(), piece["shape"]).otherwise(_pour(piece["shape"], piece["kind"], value))

        return F.array_join(F.transform(_pieces(match), part), "")

    dirty = dirty.select("_row", "_map", F.split("text", ANY, -1).alias("_between"), _matches(F.col("text")).alias("_matches"))
    dirty = dirty.select("_row", "_between", F.transform("_matches", rewritten).alias("_new"))
    joined = F.transform("_between", lambda between, i: F.concat(between, F.coalesce(F.get("_new", i), F.lit(""))))
    dirty = dirty.select("_row", F.array_join(joined, "").alias("text"), F.size("_new").cast("bigint").alias("n_entities"))
    return clean.select("_row", "text", "n_entities").union(dirty).select(*columns)
