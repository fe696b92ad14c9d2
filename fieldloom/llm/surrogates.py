"""Surrogates for personal data (DataFrame functions only).

Mail addresses, phone, card and social security numbers, IP addresses, IBANs and names are found by patterns; each is cut
into parts (local part and host, given name and surname), and each part gets a replacement drawn by a keyed hash of its
kind and canonical form. So one entity has one replacement in all documents and spellings. A name is all capitalised words
behind a title, or behind a listed given name; its words stand for the person wherever else a document has them, and
are replaced there in the same way. A given name has one gender in the whole corpus. Replacements keep the form:
separators, country code, first digit and Luhn validity of cards, letter case, script, and the gender of given names.
All distinct parts of the corpus are checked: where two would get the same replacement, or one that is a real value
somewhere, all but the first draw again, until none clash.

Limits: a person who is never named with a title, nor with one of the listed given names, is not found; a word that a document
has as a name is replaced there even where it means something else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .base import cut

MAIL, HOST, PHONE, CARD, IP, SSN, IBAN, MALE, FEMALE, GIVEN, SURNAME = range(11)
LITERAL = -1
NAMES = ["mail", "host", "phone", "card", "ip", "ssn", "iban", "given name", "given name", "given name", "surname"]

# ---- fixed values: titles and given names by gender, syllables of surnames by script
MALE_TITLES = "Mr Mister Sir Herr Monsieur Señor Sr Signor Господин"
FEMALE_TITLES = "Mrs Ms Miss Lady Frau Madame Mme Mlle Señora Sra Señorita Signora Госпожа"
TITLES = "Dr Prof Professor"
MALE_LATIN = ("James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Paul Peter Hans Karl Jürgen Pierre Jean Luc Carlos José Luis "
              "Mohammed Ahmed Omar Wei Rahul Arjun Vikram Hiroshi Kenji Pedro Miguel Giovanni Marco Lars Sven Piotr Kwame")
FEMALE_LATIN = ("Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Anna Emma Laura Ursula Monika Heidi Marie Claire Sophie Carmen Lucía Elena "
                "Fatima Aisha Priya Ananya Lakshmi Yuki Sakura Mei Rosa Isabel Giulia Francesca Ingrid Astrid Agnieszka Ama")
MALE_CYRILLIC = "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей"
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана"
MALE_GREEK = "Γιώργος Νίκος Κώστας Δημήτρης"
FEMALE_GREEK = "Μαρία Ελένη Κατερίνα Σοφία"
LATIN_PARTS = "ba ber bo cal cor da del dor fa fen gar gel ha hol ka kel kin la lem lo ma mar men mor na nel no pa per ra ren ro sa sel sto ta tel ton va ver wil zan"
CYRILLIC_PARTS = "ба бер во гал гор да дел до ка ков лев ло ма мар мен мор на но па пе ра ро са се сто та ти ва ве зан"
GREEK_PARTS = "βα γα δα δι κα κο λα λε μα με να νο πα πε ρα ρο σα σι τα το"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
# -------------------------------------------------------------------------------------------

_LETTERS = r"\p{Lu}[\p{L}-]*+(?:['’]\p{Lu}[\p{L}-]*+)*+"


def _any(words: str) -> str:
    return "|".join(words.split())


_MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
_CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
MALE_TITLES, FEMALE_TITLES = f"{MALE_TITLES} {MALE_TITLES.upper()}", f"{FEMALE_TITLES} {FEMALE_TITLES.upper()}"
_ALL_TITLES = _any(f"{MALE_TITLES} {FEMALE_TITLES} {TITLES} {TITLES.upper()}")
_ALL_GIVEN = _any(f"{MALE_LATIN} {FEMALE_LATIN} {MALE_CYRILLIC} {FEMALE_CYRILLIC} {MALE_GREEK} {FEMALE_GREEK}")
# the look-ahead lets most places fail before the names are tried
_MORE = rf"(?: (?!(?:{_ALL_TITLES})\b){_LETTERS})*+"
_NAME = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_ALL_TITLES})\.? {_LETTERS}{_MORE}|(?:{_ALL_GIVEN}) {_LETTERS}{_MORE})"
_WORD = rf"(?<![\p{{L}}\p{{N}}]){_LETTERS}"
ENTITY = "|".join([_MAIL, _IBAN, _IP, _SSN, _PHONE, _CARD, _NAME])
#: true for every text with an entity, and cheap
_HINT = rf"[0-9@]|(?=\p{{Lu}})(?:(?:{_ALL_TITLES})\.? |(?:{_ALL_GIVEN}) )"
PART = "struct<kind:int,raw:string,canon:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once for body: the optimizer does not inline a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(kind, raw: Column, canon: Column | None = None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, int) else kind).cast("int").alias("kind"), raw.alias("raw"), (F.lit(None).cast("string") if canon is None else canon).alias("canon"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _parts(m: Column) -> Column:
    """The parts of one match; literals between them included."""
    local, host = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    mail = F.array(_part(MAIL, local, F.lower(m)), _part(LITERAL, F.lit("@")), _part(HOST, host, F.lower(host)))
    title = F.regexp_extract(m, rf"^((?:{_ALL_TITLES})\.? )", 1)
    rest = F.substring(m, F.length(title) + 1, F.length(m))
    first = F.substring_index(rest, " ", 1)
    is_in = lambda c, words: c.rlike(f"^(?:{_any(words)})\\b")
    gender = (F.when(is_in(title, MALE_TITLES) | is_in(first, f"{MALE_LATIN} {MALE_CYRILLIC} {MALE_GREEK}"), MALE)
              .when(is_in(title, FEMALE_TITLES) | is_in(first, f"{FEMALE_LATIN} {FEMALE_CYRILLIC} {FEMALE_GREEK}"), FEMALE).otherwise(GIVEN))

    def parts_of(x: Column) -> Column:
        last = F.size(x["words"]) - 1
        return F.flatten(F.transform(x["words"], lambda w, i: F.array(
            _part(LITERAL, F.when(i > 0, " ").otherwise("")), _part(F.when(i < last, x["gender"]).otherwise(SURNAME), w, F.lower(w)))))

    named = _let(F.struct(F.split(rest, " ").alias("words"), gender.alias("gender")), parts_of)
    name = F.filter(F.concat(F.array(_part(LITERAL, title)), named), lambda p: p["raw"] != "")
    one = lambda kind, canon: F.array(_part(kind, m, canon))
    return (F.when(m.contains("@"), mail).when(m.rlike(f"^(?:{_IP})$"), one(IP, m)).when(m.rlike(f"^(?:{_SSN})$"), one(SSN, _digits(m)))
            .when(m.rlike("^[A-Z]{2}[0-9]{2}"), one(IBAN, F.regexp_replace(m, " ", "")))
            .when(m.startswith("+"), one(PHONE, F.concat(F.lit("+"), _digits(m))))
            .when(m.rlike("^[(0-9]"), F.when(F.length(_digits(m)) >= 13, one(CARD, _digits(m))).otherwise(one(PHONE, _digits(m))))
            .otherwise(name))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check, modulo 10."""
    n = F.length(digits)
    d = lambda i: F.substring(digits, i.cast("int"), F.lit(1)).cast("int")
    twice = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(d(i))).otherwise(d(i))) % 10


def _shaped(c: Column, h: Column) -> Column:
    """Letters become letters of the same script, digits digits, other characters stay."""
    letters = lambda alphabet, v: F.substring(F.lit(alphabet), (v % len(alphabet) + 1).cast("int"), F.lit(1))

    def char(x: Column, i: Column) -> Column:
        v = F.conv(F.substring(h, (2 * (i % 60) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return (F.when(x.rlike("[0-9]"), (v % 10).cast("string")).when(x.rlike("[a-z]"), letters("abcdefghijklmnopqrstuvwxyz", v))
                .when(x.rlike("[A-Z]"), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v)).when(x.rlike("\\p{IsCyrillic}"), letters(CYRILLIC, v))
                .when(x.rlike("\\p{IsGreek}"), letters(GREEK, v)).when(x.rlike("\\p{L}"), letters("abcdefghijklmnopqrstuvwxyz", v)).otherwise(x))
    return F.array_join(F.transform(F.split(c, ""), char), "")


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The replacement of a part in canonical form: digits for numbers, lower case for names and addresses."""
    # the two genders unknown and known draw alike, so only the kind's list differs
    hashed = F.sha2(F.concat_ws("|", F.lit(key), kind.cast("string"), canon, attempt.cast("string")), 512)

    def drawn(h: Column) -> Column:
        digits = F.translate(h, "abcdef", "012345")
        byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")
        pick = lambda words, i: F.element_at(F.array(*map(F.lit, words.lower().split())), byte(i) % len(words.split()) + 1)
        more = F.when(attempt >= 3, F.substring(digits, F.lit(60), attempt)).otherwise("")
        fill = lambda start: F.concat(F.substring(canon, F.lit(1), start), F.substring(digits, F.lit(1), F.length(canon) - start))
        code = F.when(canon.startswith("+"), F.when(canon.rlike("^\\+[17]"), 2).otherwise(3)).otherwise(0)
        card = fill(F.lit(1))
        valid = F.concat(F.substring(card, F.lit(1), F.length(card) - 1), F.lit("0"))
        card = F.when(_luhn(canon) == 0, F.concat(F.substring(valid, F.lit(1), F.length(valid) - 1), ((10 - _luhn(valid)) % 10).cast("string"))).otherwise(card)
        ip = F.concat_ws(".", *[(byte(i) % 254 + 1).cast("string") for i in range(4)])
        head, end = F.regexp_extract(canon, "^(.*)\\.[^.]*$", 1), F.regexp_extract(canon, "(\\.[^.]*)$", 1)
        iban = F.concat(F.substring(canon, 1, 2), _shaped(F.substring(canon, F.lit(3), F.length(canon)), h))

        def given(latin: str, cyrillic: str, greek: str) -> Column:
            def two(words: str) -> Column:
                return F.when(attempt == 0, pick(words, 0)).otherwise(F.concat(pick(words, 0), F.lit("-"), pick(words, 1), F.when(attempt >= 3, F.concat(F.lit("-"), pick(words, 2))).otherwise(""),
                                                                              F.when(attempt >= 6, F.concat(F.lit("-"), pick(words, 3), F.substring(h, F.lit(20), attempt))).otherwise("")))
            return F.when(canon.rlike("\\p{IsCyrillic}"), two(cyrillic)).when(canon.rlike("\\p{IsGreek}"), two(greek)).otherwise(two(latin))

        def surname(parts: str) -> Column:
            return F.concat(*[pick(parts, i) for i in range(3)], F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.when(i > 0, pick(parts, 5)).otherwise("")), ""),
                            F.when(attempt >= 2, pick(parts, 6)).otherwise(""))

        family = F.when(canon.rlike("\\p{IsCyrillic}"), surname(CYRILLIC_PARTS)).when(canon.rlike("\\p{IsGreek}"), surname(GREEK_PARTS)).otherwise(surname(LATIN_PARTS))
        return (F.when(kind == MAIL, F.concat(_shaped(F.regexp_extract(canon, "^([^@]*)", 1), h), more)).when(kind == HOST, F.concat(_shaped(head, h), more, end))
                .when(kind == PHONE, fill(code)).when(kind == CARD, card).when(kind == SSN, fill(F.lit(0))).when(kind == IP, ip).when(kind == IBAN, iban)
                .when(kind == MALE, given(MALE_LATIN, MALE_CYRILLIC, MALE_GREEK)).when(kind == FEMALE, given(FEMALE_LATIN, FEMALE_CYRILLIC, FEMALE_GREEK))
                .when(kind == GIVEN, given(f"{MALE_LATIN} {FEMALE_LATIN}", f"{MALE_CYRILLIC} {FEMALE_CYRILLIC}", f"{MALE_GREEK} {FEMALE_GREEK}"))
                .otherwise(family))

    return _let(hashed, drawn)


def _written(p: Column, s: Column) -> Column:
    """A replacement in the spelling of the text: its separators and letter case."""
    own = _digits(s)
    chars = F.split(F.when(p["kind"] == IBAN, s).otherwise(own), "")
    between = F.split(p["raw"], F.when(p["kind"] == IBAN, "[A-Z0-9]").otherwise("[0-9]"), -1)
    number = F.array_join(F.zip_with(between, chars, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    upper = (F.upper(p["raw"]) == p["raw"]) & (F.lower(p["raw"]) != p["raw"]) & (F.length(p["raw"]) > 1)
    title = F.array_join(F.transform(F.split(s, "-"), lambda x: F.initcap(x)), "-")
    word = F.when(upper, F.upper(s)).when((p["kind"] >= MALE) & (F.substring(p["raw"], 1, 1) != F.lower(F.substring(p["raw"], 1, 1))), title).otherwise(s)
    return F.when(p["kind"].isin(PHONE, CARD, SSN, IBAN), number).otherwise(word)


def distinct_surrogates(units: DataFrame, key: str) -> DataFrame:
    """kind, canon, s for the distinct parts (kind, canon) whose first draw does not hold: it clashes with another part or
    a real value, or the part is a given name that has another gender elsewhere."""
    value = F.when(F.col("kind") == MAIL, F.concat("s", F.regexp_extract("canon", "(@.*)$", 1))).otherwise(F.col("s"))
    draw = lambda df: df.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)).withColumn("value", value)
    # given names of both genders stand in one space
    space = F.when(F.col("kind").between(MALE, GIVEN), MALE).otherwise(F.col("kind"))
    # a given name that stands with several genders, or with and without one, gets the one it has, or none of two
    given = F.col("kind").between(MALE, GIVEN)
    has = lambda k: F.max(F.col("kind") == k)
    one = units.where(given).groupBy("canon").agg(F.count("*").alias("n"), F.when(has(MALE) & has(FEMALE), GIVEN).when(has(MALE), MALE).when(has(FEMALE), FEMALE).otherwise(GIVEN).alias("one")).where("n > 1").drop("n")
    known_as = cut(units.join(one, "canon", "left").select("canon", F.col("kind").alias("seen"), F.when(given, F.coalesce("one", "kind")).otherwise(F.col("kind")).alias("kind")), "kinds")
    now = cut(draw(known_as.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).withColumn("space", space)), "draw0")
    real = now.select("space", F.col("canon").alias("value")).distinct()
    turn = 0
    while True:
        first = now.groupBy("space", "value").agg(F.min(F.struct("canon", "kind")).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = now.join(first, ["space", "value"]).where("not (canon = first.canon and kind = first.kind)").select("kind", "canon")
        known = now.join(real, ["space", "value"], "left_semi").select("kind", "canon")
        clash = cut(later.unionByName(known).distinct().withColumn("again", F.lit(1)), f"clash{turn}")
        if not clash.take(1):
            return known_as.join(now, ["kind", "canon"]).where("attempt > 0 or kind != seen").select(F.col("seen").alias("kind"), "canon", "s")
        turn += 1
        again = now.join(clash, ["kind", "canon"], "left")
        now = cut(draw(again.withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("again", "s", "value")), f"draw{turn}")


def _named_again(parts: Column) -> Column:
    """The parts with literals cut where they have a word of a name that the text has elsewhere."""
    def names(ps: Column) -> Column:
        every = F.array_sort(F.array_distinct(F.transform(F.filter(ps, lambda p: p["kind"] >= MALE), lambda p: F.struct(p["canon"].alias("canon"), p["kind"].alias("kind")))))
        # the last kind of each word, a surname if it is one
        last = lambda xs: F.filter(xs, lambda x, i: ~F.coalesce(F.get(xs, i + 1)["canon"] == x["canon"], F.lit(False)))
        return F.map_from_entries(_let(every, last))

    def cut_up(p: Column, known: Column) -> Column:
        words = F.transform(F.regexp_extract_all(p["raw"], F.lit(_WORD), F.lit(0)), lambda w: _part(
            F.coalesce(F.element_at(known, F.lower(w)), F.lit(LITERAL)), w, F.when(F.element_at(known, F.lower(w)).isNotNull(), F.lower(w))))
        between = F.transform(F.split(p["raw"], _WORD, -1), lambda x: _part(LITERAL, x))
        return F.flatten(F.zip_with(between, words, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))

    again = lambda known: F.flatten(F.transform(parts, lambda p: F.when(p["kind"] == LITERAL, cut_up(p, known)).otherwise(F.array(p))))
    return F.when(F.exists(parts, lambda p: p["kind"] >= MALE), _let(names(parts), again)).otherwise(parts)


def with_surrogates(docs: DataFrame, key: str = "fieldloom") -> DataFrame:
    """doc_id, text (entities replaced), n_entities and counts (map of kind to number) for each row of docs (doc_id, text).

    Null texts stay null, texts without entities stay as they are; repeated rows come back as often as given. The
    replacement of an entity depends on the key and on the values of the corpus. Of several readings of a word as a part
    of a name (given name, surname) a bare mention takes the surname. Other columns are not read.
    """
    text = F.col("text")
    pieces = F.transform(F.split(text, ENTITY, -1), lambda x: F.array(_part(LITERAL, x)))
    hits = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), _parts)
    woven = F.flatten(F.zip_with(pieces, hits, lambda a, b: F.when(b.isNull(), a).otherwise(F.concat(a, b))))
    woven = _let(woven, _named_again)
    some = F.coalesce(text.rlike(_HINT), F.lit(False)) & F.coalesce(text.rlike(ENTITY), F.lit(False))
    rows = cut(docs.select("doc_id", "text").select("doc_id", F.when(~some, text).alias("text"), F.when(some, F.md5("text")).alias("text_key"),
                                                    F.when(some, woven).alias("parts")), "parts")
    held = rows.where("parts is not null").select("text_key", F.explode(F.filter("parts", lambda p: p["kind"] >= 0)).alias("p")).select("text_key", "p.kind", "p.canon").distinct()
    held = cut(held, "held")
    redrawn = distinct_surrogates(held.select("kind", "canon").distinct(), key)
    name = lambda k, c: F.concat_ws("|", k.cast("string"), c)
    # one row for each text with such a part, bounded by the parts of the text
    own = held.join(redrawn, ["kind", "canon"]).groupBy("text_key").agg(
        F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("canon")), "s"))).alias("redrawn"))
    # texts without entities take no part in the join: they have no key and would all meet in one task
    both = rows.where("parts is not null").join(own, "text_key", "left").unionByName(
        rows.where("parts is null").withColumn("redrawn", F.lit(None).cast("map<string,string>")))
    put = lambda p: F.when(p["kind"] < 0, p["raw"]).otherwise(_written(p, F.coalesce(
        F.element_at("redrawn", name(p["kind"], p["canon"])), surrogate(p["kind"], p["canon"], F.lit(0), key))))
    entities = F.filter("parts", lambda p: (p["kind"] >= 0) & ~p["kind"].isin(HOST, MALE, FEMALE, GIVEN))
    count = lambda k: F.coalesce(F.size(F.filter(entities, lambda p: p["kind"] == k)), F.lit(0)).cast("long")
    return both.select(
        "doc_id", F.when(F.col("parts").isNull(), F.col("text")).otherwise(F.array_join(F.transform("parts", put), "")).alias("text"),
        *[count(k).alias(f"n_{n}") for k, n in ((MAIL, "mail"), (PHONE, "phone"), (CARD, "card"), (IP, "ip"), (SSN, "ssn"), (IBAN, "iban"), (SURNAME, "name"))])
