"""Personal data: detected entities receive keyed, type-consistent surrogates.

DataFrame functions only. Each distinct entity (its canonical form: the digits of a phone number, the lower-cased
letters of an e-mail address, each single word of a name) has one surrogate in all documents, drawn from a keyed
hash and written in the form of the place it replaces: punctuation, letter case, lengths, a country code, a private
network, a valid check digit, the gender and script of a name stay. Two people of one surname, or "Mr. Lund" after
"Mr. Nils Lund", keep that in common. The gender that a title gives a full name anywhere is that of the name where
no title says one.

An address's host is an entity of its own, so that colleagues stay colleagues and two hosts stay two. A phone number
that begins with + keeps its country code. People are found behind titles, and by their names alone behind the phrases
of INTRODUCTIONS.

Collision checks: the surrogates of all distinct entities are compared, with each other and with all entities that
occur; those that meet are drawn again (attempt 1, 2, ...) until none does. Documents then only need the attempts
that are above 0, joined by entity; everything else follows from key, entity and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspan.llm.common import table, written
from tallyspan.llm.quality_rules import let

KEY = "surrogate-key"
#: Draws of an entity until it is given up, and those after which letters are added to a form that may be full.
MOST_ATTEMPTS, ROOMY_FROM = 64, 8
#: Country codes: of one digit, of two, else of three (fixed values).
COUNTRY_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа")
NEUTRAL = ("Dr", "Prof")
#: What a person's name without a title follows, in four languages.
INTRODUCTIONS = ("my name is ", "My name is ", "ich heiße ", "Ich heiße ", "mein Name ist ", "Mein Name ist ", "je m'appelle ", "Je m'appelle ", "mon nom est ", "Mon nom est ", "me llamo ", "Me llamo ", "mi nombre es ", "Mi nombre es ")
#: Labels of a host: as many as its name in 253 characters can have.
MOST_LABELS = 127
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Type and pattern, in the order in which they are tried at a place.
PATTERNS = {
    # from where a run of its characters begins (or the last entity ended): each run is read once
    "email": rf"(?:\G|(?<![\p{{L}}0-9._%+-]))[\p{{L}}0-9._%+-]++@(?:[A-Za-z0-9-]++\.){{1,{MOST_LABELS - 1}}}[A-Za-z]{{2,}}",
    "secret": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"
    r"|(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
    r"|(?<=(?:token|secret|passwd|password|api_key|api-key|apikey|access_key)\s{0,3}[=:]\s{0,3}[\"']{0,1})[A-Za-z0-9+/_=-]{12,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": r"\d(?:[ -]?\d){12,18}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|\d{3}[-. ]\d{3}[-. ]\d{4}(?!\d)",
    "person": rf"(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
    "name": rf"(?<={'|'.join(INTRODUCTIONS)})\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
}
TITLED = rf"^(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? "
#: An address may follow a dot or another mark; the other types begin where no letter or digit stands before.
ANY = rf"(?:{PATTERNS['email']}|(?<![\p{{L}}0-9_+])(?:{'|'.join(f'(?:{p})' for n, p in PATTERNS.items() if n != 'email')}))"
#: What any entity holds: most texts are passed over by this alone. Tests hold it against ANY.
HINT = rf"@|\d[\d ().+-]{{3,}}\d|[A-Z]{{2}}\d{{2}}[A-Z0-9 ]{{12}}|[0-9A-Za-z+/_=-]{{12,}}|(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.? \p{{Lu}}|{'|'.join(INTRODUCTIONS)}"
VOWELS, CYRILLIC_VOWELS, GREEK_VOWELS = "aeiou", "аеиоу", "αειου"
CONSONANTS, CYRILLIC_CONSONANTS, GREEK_CONSONANTS = "bdfgklmnprstvz", "бвгдзклмнпрст", "βγδκλμνπρστφ"
#: Letters that others of their script become.
CYRILLIC, GREEK = CYRILLIC_VOWELS + CYRILLIC_CONSONANTS, GREEK_VOWELS + GREEK_CONSONANTS
SEP = "\x1f"


def matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def type_of(entity: Column) -> Column:
    """The type of an entity, by the patterns in their order; letters alone that no other pattern takes are a name."""
    out = F.when(entity.rlike(r"^\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?$"), F.lit("person")).otherwise(F.lit("secret"))
    for name, pattern in reversed(PATTERNS.items()):
        if name == "name":
            continue  # what comes before it is not in the entity
        out = F.when(entity.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def gender_of(entity: Column) -> Column:
    """f or m by a person's title, null without one that says so."""
    title = F.regexp_replace(F.when(entity.rlike(TITLED), F.substring_index(entity, " ", 1)).otherwise(F.lit("")), r"\.$", "")
    return F.when(title.isin(*FEMALE), F.lit("f")).when(title.isin(*MALE), F.lit("m"))


def full_name(entity: Column) -> Column:
    """"full US name" of a person named in full; null for others. Its attempt says the gender that titles elsewhere give it."""
    words = _name_words(entity)
    return F.when((type_of(entity) == "person") & (F.size(words) > 1), F.concat(F.lit(f"full{SEP}"), F.lower(F.array_join(words, " "))))


def units(entity: Column, known: Column | None = None) -> Column:
    """An entity's units as "type US canonical form": one, but for a name one per word, for an address also its host.

    known: the gender of a person whose title says none (f, m or null).
    """
    kind = type_of(entity)
    titled = entity.rlike(TITLED)
    words = _name_words(entity)
    last = F.element_at(F.split(entity, " "), -1)
    script = F.when(last.rlike(r"\p{IsCyrillic}"), F.lit("c")).when(last.rlike(r"\p{IsGreek}"), F.lit("g")).otherwise(F.lit("l"))
    gender = F.coalesce(gender_of(entity), F.lit(None).cast("string") if known is None else known, F.lit("n"))
    family = F.concat(F.lit("family-"), script, F.lit(SEP), F.lower(F.element_at(words, -1)))
    given = F.concat(F.lit("given-"), script, F.lit("-"), gender, F.lit(SEP), F.lower(F.get(words, F.lit(0))))
    plus = F.when(entity.startswith("+"), F.lit("+")).otherwise(F.lit(""))
    canonical = F.when(kind == "phone", F.concat(plus, _digits(entity))).when(kind.isin("card", "ssn"), _digits(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(entity)).otherwise(entity)
    person = F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(F.when(titled, family).otherwise(given)))
    own = F.concat(kind, F.lit(SEP), canonical)
    return F.when(kind == "person", person).when(kind == "email", F.array(own, _host_unit(entity))).otherwise(F.array(own))


def _name_words(entity: Column) -> Column:
    """The words of a person's name, without the title."""
    return F.split(F.regexp_replace(entity, TITLED, ""), " ")


def _host_unit(address: Column) -> Column:
    return F.concat(F.lit(f"host{SEP}"), F.lower(F.substring_index(address, "@", -1)))


def _stream(key: str, unit: Column, attempt: Column) -> Column:
    """256 hex digits: the keyed hash of a unit and attempt (the key inside and outside, as in HMAC)."""
    inner = F.concat_ws(SEP, F.lit(key), unit, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(F.lit(key), F.sha2(F.concat(inner, F.lit(f"{SEP}{n}")), 256)), 256) for n in range(4)))


def _byte(stream: Column, n: Column) -> Column:
    """Byte n of a stream of 128; each turn through them is shifted by another number."""
    turn = F.floor(n / 128).cast("int")
    return F.conv(F.substring(stream, (n % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int") + turn % 251 * 7


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _redrawn(form: Column, stream: Column, first: Column) -> Column:
    """form with each letter and digit from place first on (counted without other characters) drawn anew in its class.

    Letters stay in their script (Latin, Greek, Cyrillic; others become Latin ones) and case. The places are those in the
    form without other characters, which are woven in again: one pass each, whatever the length.
    """
    hexa = form.rlike(r"^[0-9a-fA-F]+$")
    small = "abcdefghijklmnopqrstuvwxyz"

    def character(c: Column, b: Column) -> Column:
        capital = c.rlike(r"\p{Lu}")
        case = lambda drawn: F.when(capital, F.upper(drawn)).otherwise(drawn)
        return (
            F.when(c.rlike(r"\d"), _pick("0123456789", b))
            .when(c.rlike(r"[a-z]"), F.when(hexa, _pick("abcdef", b)).otherwise(_pick(small, b)))
            .when(c.rlike(r"[A-Z]"), F.when(hexa, _pick("ABCDEF", b)).otherwise(_pick(small.upper(), b)))
            .when(c.rlike(r"\p{IsCyrillic}"), case(_pick(CYRILLIC, b)))
            .when(c.rlike(r"\p{IsGreek}"), case(_pick(GREEK, b)))
            .when(c.rlike(r"\p{L}"), _pick(small, b))
            .otherwise(c)
        )

    plain = F.regexp_replace(form, r"[^\p{L}0-9]", "")
    drawn = F.transform(F.split(plain, ""), lambda c, i: F.when(i < first, c).otherwise(character(c, _byte(stream, i))))
    between = F.split(form, r"[\p{L}0-9]")
    return let(drawn, lambda letters: F.array_join(F.transform(between, lambda s, i: F.concat(s, F.coalesce(F.get(letters, i), F.lit("")))), ""))


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule over a string of digits; valid when a multiple of 10."""
    n = F.char_length(digits)
    part = lambda c, i: let(c.cast("int") * F.when((n - i) % 2 == 0, F.lit(2)).otherwise(F.lit(1)), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x)


def _name(unit: Column, stream: Column) -> Column:
    """A made-up name word in the unit's script: syllables, and for a given name an ending of its gender."""
    kind = F.substring_index(unit, SEP, 1)
    cyrillic, greek = kind.contains("-c"), kind.contains("-g")
    script = lambda c, g, latin: F.when(cyrillic, c).when(greek, g).otherwise(latin)
    pick = lambda letters, n: _pick(letters, _byte(stream, F.lit(n)))
    syllable = lambda n: script(
        *(F.concat(pick(c, 2 * n), pick(v, 2 * n + 1)) for c, v in ((CYRILLIC_CONSONANTS, CYRILLIC_VOWELS), (GREEK_CONSONANTS, GREEK_VOWELS), (CONSONANTS, VOWELS)))
    )
    word = lambda c, g, latin: script(F.lit(c), F.lit(g), F.lit(latin))
    ending = F.when(kind.endswith("-f"), word("на", "να", "na")).when(kind.endswith("-m"), word("н", "νος", "n")).when(kind.startswith("family"), word("ко", "ιδης", "son")).otherwise(word("и", "ι", "el"))
    return F.initcap(F.concat(syllable(0), syllable(1), syllable(2), syllable(3), ending))


def surrogate(entity: Column, attempt_of, key: str = KEY) -> Column:
    """The surrogate for an entity as written; attempt_of(unit) gives the unit's attempt, that of a full name its gender."""
    code = attempt_of(full_name(entity))
    own = units(entity, F.when(code == 1, F.lit("f")).when(code == 2, F.lit("m")))
    first = F.get(own, F.lit(0))
    kind = F.substring_index(first, SEP, 1)

    def single(unit: Column) -> Column:
        return let(_stream(key, unit, attempt_of(unit)), lambda stream: _rendered(entity, kind, stream, attempt_of(unit)))

    def address(unit: Column) -> Column:
        host = _host_unit(entity)
        new_host = let(_stream(key, host, attempt_of(host)), lambda s: _host(F.substring_index(entity, "@", -1), s, attempt_of(host)))
        return F.concat(F.substring_index(single(unit), "@", 1), F.lit("@"), new_host)

    title = F.regexp_extract(entity, TITLED, 0)
    names = F.transform(own, lambda u: let(_stream(key, u, attempt_of(u)), lambda s: _name(u, s)))
    person = kind.startswith("family") | kind.startswith("given")
    return F.when(person, F.concat(title, F.array_join(names, " "))).when(kind == "email", address(first)).otherwise(single(first))


def _roomy(form: Column, attempt: Column) -> Column:
    """form, from attempt ROOMY_FROM on with four more letters: few other values may have its length."""
    return F.concat(form, F.when(attempt >= ROOMY_FROM, F.lit("aaaa")).otherwise(F.lit("")))


def _host(host: Column, stream: Column, attempt: Column) -> Column:
    """A host with all before its top level drawn anew."""
    return F.concat(_redrawn(_roomy(F.regexp_extract(host, r"^(.*)\.[^.]+$", 1), attempt), stream, F.lit(0)), F.lit("."), F.substring_index(host, ".", -1))


def _rendered(entity: Column, kind: Column, stream: Column, attempt: Column) -> Column:
    """The surrogate of an entity that is one unit; of an address, the local part's, at the old host."""
    code = F.when(entity.startswith("+"), F.regexp_extract(_digits(entity), COUNTRY_CODE, 1)).otherwise(F.lit(""))
    address = F.concat(_redrawn(_roomy(F.substring_index(entity, "@", 1), attempt), stream, F.lit(0)), F.lit("@"), F.substring_index(entity, "@", -1))
    octets = F.split(entity, r"\.")
    private = F.when(entity.startswith("10."), 1).when(entity.startswith("192.168."), 2).when(entity.rlike(r"^172\.(1[6-9]|2\d|3[01])\."), 2).when(entity.startswith("127."), 1).otherwise(0)
    drawn = F.transform(octets, lambda o, i: F.when(i < private, o).otherwise((F.when(i == 0, F.lit(11) + _byte(stream, i) % 89).otherwise(_byte(stream, i) % 254 + 1)).cast("string")))
    card = let(_redrawn(entity, stream, F.lit(0)), lambda x: F.when(_luhn(_digits(entity)) % 10 == 0, _with_check_digit(x)).otherwise(x))
    return (
        F.when(kind == "email", address)
        .when(kind == "ip", F.array_join(drawn, "."))
        .when(kind == "card", card)
        .when(kind == "phone", _redrawn(entity, stream, F.char_length(code)))
        .when(kind == "iban", _redrawn(entity, stream, F.lit(2)))
        .otherwise(_redrawn(entity, stream, F.lit(0)))
    )


def _with_check_digit(number: Column) -> Column:
    body = F.substring(number, F.lit(1), F.char_length(number) - 1)
    return F.concat(body, ((10 - _luhn(F.concat(_digits(body), F.lit("0"))) % 10) % 10).cast("string"))


def canonical_surrogate(unit: Column, attempt: Column, key: str) -> Column:
    """What collision checks compare: the unit form of a unit's surrogate, written in its canonical form.

    Its letters and digits are those that are written into the text, the country code kept as there. An address keeps
    its host here: hosts are units, no two of which become one or a real one, so addresses differ if they do here.
    """
    kind, form = F.substring_index(unit, SEP, 1), F.substring_index(unit, SEP, -1)
    named = kind.startswith("family") | kind.startswith("given")
    drawn = let(_stream(key, unit, attempt), lambda s: F.when(named, F.lower(_name(unit, s))).when(kind == "host", _host(form, s, attempt)).otherwise(_rendered(form, kind, s, attempt)))
    return F.concat(kind, F.lit(SEP), drawn)


def attempts(found: DataFrame, key: str = KEY) -> DataFrame:
    """Rows (unit, attempt) of the units whose first surrogate met another unit or surrogate; from a column unit, distinct."""
    now = written(found.select("unit", F.lit(0).alias("attempt")).withColumn("new", canonical_surrogate(F.col("unit"), F.col("attempt"), key)), "pii-units")
    for _ in range(MOST_ATTEMPTS):
        first = now.groupBy("new").agg(F.min(F.struct("attempt", "unit")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("new", F.col("owner.unit").alias("owner"))
        real = now.select(F.col("unit").alias("new"), F.lit(True).alias("real"))
        judged = now.join(first, "new", "left").join(real, "new", "left")
        bad = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("owner") != F.col("unit"), F.lit(False))
        drawn = judged.select("unit", F.when(bad, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), "new", bad.alias("bad"))
        if drawn.where("bad").isEmpty():
            return now.where("attempt > 0").select("unit", "attempt")
        now = written(drawn.select("unit", "attempt", F.when(F.col("bad"), canonical_surrogate(F.col("unit"), F.col("attempt"), key)).otherwise(F.col("new")).alias("new")), "pii-units")
    raise ValueError(f"entities without a free surrogate after {MOST_ATTEMPTS} draws")


def replace_entities(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text with surrogates, n_entities, entity_types (sorted, joined by commas).

    A null text stays null, without entities; an empty one stays empty. Repeated rows get equal results. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    may = F.col("text").rlike(HINT)
    found = rows.where(may).withColumn("found", matches(F.col("text")))
    held = written(found.withColumn("rid", F.monotonically_increasing_id()), "pii-found")
    entities = held.where("size(found) > 0").select("rid", F.explode(F.array_distinct("found")).alias("entity"))
    entities = written(entities.withColumns({"full": full_name(F.col("entity")), "gender": gender_of(F.col("entity"))}), "pii-entities")
    # what titles say of a person holds for all mentions of the full name
    told = entities.where("full is not null and gender is not null").groupBy("full").agg(F.min("gender").alias("told"))
    told = written(told, "pii-genders")
    silent = entities.where("full is not null and gender is null").join(told, "full")
    genders = silent.select("rid", F.col("full").alias("unit"), F.when(F.col("told") == "f", 1).otherwise(2).alias("attempt"))
    known = silent.select("rid", "entity", "told").unionByName(entities.join(silent.select("rid", "entity"), ["rid", "entity"], "left_anti").select("rid", "entity", F.lit(None).cast("string").alias("told")))
    mentions = written(known.select("rid", F.explode(units(F.col("entity"), F.col("told"))).alias("unit")).distinct(), "pii-mentions")
    redrawn = written(attempts(mentions.select("unit").distinct(), key), "pii-redrawn")
    extra = mentions.join(redrawn, "unit").select("rid", "unit", "attempt").unionByName(genders).distinct()
    extra = extra.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias("attempts"))
    of = lambda unit: F.coalesce(F.element_at(F.col("attempts"), F.coalesce(unit, F.lit(""))), F.lit(0))
    pieces = F.split(F.col("text"), ANY)
    woven = F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("new"), i), F.lit(""))))
    done = held.join(extra, "rid", "left").withColumn("new", F.transform("found", lambda e: surrogate(e, of, key)))
    done = done.select("doc_id", F.array_join(woven, "").alias("text"), F.size("found").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", type_of))), ",").alias("entity_types"))
    rest = rows.where(~F.coalesce(may, F.lit(False))).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_types"))
    return done.unionByName(rest)


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"))
