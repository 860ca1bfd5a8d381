"""Personal data replaced by keyed surrogates of the same type and format.

Entities are found by one regular expression with an alternative for each
kind; numbers in the form of cards count only with right check
digits. A surrogate is drawn from a keyed hash of the kind and the canonical
entity, so an entity has the same surrogate everywhere (coreference), with the
letter case, separators, script, honorific, gender and check digits of what it
replaces. Names are replaced part by part: a surname has one surrogate whatever
honorific or first name is before it, and a first name one of the gender that
its honorifics in the corpus tell. Different entities that draw one surrogate,
or draw a real entity, are found by grouping all entities of the corpus, and
all but the smallest draw again until none collide (distinctness). Everything
is DataFrame expressions.

A name is found after an honorific or after a phrase like "my name is". Names
that stand alone are not found: expressions can't tell them from other
capitalised words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme|Господин|Госпожа|Κύριος|Κυρία"
NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?"
KEYWORD = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Kk]ey|KEY)[\"']? ?[=:] ?[\"']?"
#: Kinds in order of precedence, with Java patterns; none has a capturing group.
KINDS = {
    "email": r"(?<![\w.+%-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": rf"(?=[TtSsPpKkAg])(?:{KEYWORD}[A-Za-z0-9+/_-]{{12,}}+|\b(?:AKIA[0-9A-Z]{{16}}|ghp_[A-Za-z0-9]{{36}})\b|\bsk-[A-Za-z0-9_-]{{20,}}+)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?=\d)(?<![\d.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?:\d{1,3})?(?![\d-])",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d))",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "person": rf"(?=[MDHFPSГΚ])\b(?:{TITLES})\b\.? {NAME}|(?<=\b(?:[Nn]ame is|[Nn]ame:|[Ss]igned by|[Ss]igned:|[Ss]incerely,|[Rr]egards,)\s){NAME}",
}
ALL = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without a digit, an @ or any of these holds no entity; cheap tests before the pattern.
HINTS = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Sr", "Monsieur", "Madame", "Mme", "Господин", "Госпожа", "Κύριος", "Κυρία", "ame is ", "ame: ", "igned", "incerely, ", "egards, ", "=", ":", "AKIA", "ghp_", "sk-")

#: First names by gender and syllables of surnames, by script.
FIRST = {
    "Latin": {"f": ["Alma", "Bela", "Cora", "Dina", "Elsa", "Flora", "Greta", "Hilda"], "m": ["Anton", "Boris", "Carlo", "David", "Egon", "Felix", "Georg", "Hugo"], "n": ["Alex", "Robin", "Kim", "Jules", "Sasha", "Toni", "Noa", "Charlie"]},
    "Cyrillic": {"f": ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Инна", "Лидия", "Нина"], "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"], "n": ["Саша", "Женя", "Валя", "Слава", "Шура", "Тоня", "Митя", "Паша"]},
    "Greek": {"f": ["Άννα", "Δάφνη", "Ελένη", "Ζωή", "Θάλεια", "Ιρις", "Λητώ", "Μυρτώ"], "m": ["Άρης", "Βίκτωρ", "Δήμος", "Ηλίας", "Θωμάς", "Ιάσων", "Λουκάς", "Νίκος"], "n": ["Άλεξ", "Βαλ", "Κιμ", "Νόα", "Σαμ", "Τόνι", "Φαίη", "Χαρ"]},
}
SYLLABLES = {
    "Latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "ze"],
    "Cyrillic": ["ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ва", "зе"],
    "Greek": ["βα", "δε", "φι", "γο", "χου", "κα", "λε", "μι", "νο", "που", "ρα", "σε", "τι", "βο", "θα", "ζε"],
}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа|Κυρία)\b"
MALE = r"^(?:Mr|Herr|Señor|Sr|Monsieur|Господин|Κύριος)\b"
HONORIFIC = rf"^(?:{TITLES})\b\.? "
#: Longest entity whose letters and digits are counted for each character, which takes the square of its length.
PLAIN = 200
#: From this attempt on a surrogate has a wider form, so that kinds with few forms aren't used up.
WIDE = 6
#: Rounds of drawing again; each needs a job over the entities. Wider forms have 32 more bits, so the bound isn't met.
ROUNDS = 40
#: Up to so many entities that need a look-up are sent to every task; beyond, they are joined by shuffle.
BROADCAST_REDRAWN = 10_000


def bound(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda a, t: a + t)


def luhn(digits: Column) -> Column:
    """Sum of a number's digits, every second from the last but one doubled; 0 modulo 10 is right."""
    def term(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return _total(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), term))


def mod97(code: Column) -> Column:
    """Remainder of letters and digits read as one number, A to Z as 10 to 35."""
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(code, "(?!^)(?!$)"), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + value(c)) % 97)


def kind_of(x: Column) -> Column:
    """By form alone; none for what has the form of a card but wrong check digits, and is left as it is."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    card = F.when(luhn(digits) % 10 == 0, "card").otherwise("none")
    return (
        F.when(x.rlike(f"^{KEYWORD}|^AKIA|^ghp_|^sk-"), "secret").when(F.contains(x, F.lit("@")) & x.rlike(r"\.[A-Za-z]{2,}$"), "email").when(x.rlike(HONORIFIC) | x.rlike(f"^{NAME}$"), "person").when(x.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(x.rlike(r"^\d{4}(?:[ -]?\d{4}){3}\d{0,3}$"), card).when(x.rlike(r"^\+?[\d(][\d ().-]*\d$"), "phone").otherwise("iban")
    )


def canon(kind: Column, x: Column) -> Column:
    """What mentions of one entity share, without case or separators."""
    bare = F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(x, "[^0-9]", "")).when(kind == "iban", F.replace(x, F.lit(" "), F.lit(""))).otherwise(F.lower(x))
    return F.concat(kind, F.lit(":"), bare)


def described(xs: Column) -> Column:
    """Entities as structs of head, which stays, and parts, which are replaced: x, kind, gender and canon of each. A person's parts are names, other entities have one."""
    kinds = F.transform(xs, lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind")))
    head = lambda e: F.when(e["kind"] == "person", F.regexp_extract(e["x"], HONORIFIC, 0)).when(e["kind"] == "secret", F.regexp_extract(e["x"], f"^{KEYWORD}", 0)).otherwise("")
    cut_up = F.transform(kinds, lambda e: F.struct(e["x"].alias("x"), e["kind"].alias("kind"), head(e).alias("head")))

    def parts(e: Column) -> Column:
        body = F.substring(e["x"], F.length(e["head"]) + 1, F.length(e["x"]))
        names = F.when(e["kind"] == "person", F.split(body, " ")).otherwise(F.array(body))
        gender = F.when(e["head"].rlike(FEMALE), "f").when(e["head"].rlike(MALE), "m").otherwise("n")
        one_kind = lambda i: F.when(e["kind"] != "person", e["kind"]).when((i == 0) & ((F.size(names) > 1) | (e["head"] == "")), "first").otherwise("last")
        with_kind = F.transform(names, lambda n, i: F.struct(n.alias("x"), one_kind(i).alias("kind")))
        return F.transform(with_kind, lambda p: F.struct(p["x"].alias("x"), p["kind"].alias("kind"), F.when(p["kind"] == "first", gender).otherwise("").alias("gender"), canon(p["kind"], p["x"]).alias("canon")))

    return F.transform(cut_up, lambda e: F.struct(e["head"].alias("head"), (e["kind"] == "none").alias("stays"), parts(e).alias("parts")))


def _hex(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(key), *parts), 256)


def _draw(h: Column, i: Column) -> Column:
    """The i-th 32-bit number drawn from h."""
    return F.conv(F.substring(F.sha2(F.concat(h, i.cast("string")), 256), 1, 8), 16, 10).cast("long")


def _nth(h: Column, i: Column, n: int) -> Column:
    return F.pmod(_draw(h, i), F.lit(n)).cast("int")


def _letter(n: Column) -> Column:
    return F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n + 1, F.lit(1))


def _redrawn(x: Column, h: Column, keep: int | Column = 0) -> Column:
    """x with every ASCII letter and digit after the first `keep` characters drawn anew, by its place among those (among all in entities longer than PLAIN, none of which have canonical forms without separators); case, separators and the hexadecimal alphabet stay."""
    keep = F.lit(keep) if isinstance(keep, int) else keep
    placed = F.transform(F.split(x, "(?!^)(?!$)"), lambda c, i: F.struct(c.alias("c"), (i >= keep).alias("free"), F.when(F.length(x) > PLAIN, i + 1).otherwise(F.length(F.regexp_replace(F.substring(x, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))).alias("at")))
    letters = F.when(x.rlike("^[0-9A-Fa-f]{16,}$"), 6).otherwise(26)
    drawn = F.transform(placed, lambda p: F.struct(p["c"].alias("c"), F.when(p["free"] & p["c"].rlike("[0-9A-Za-z]"), _nth(h, p["at"], 7800)).alias("n")))
    one = lambda d: F.when(d["n"].isNull(), d["c"]).when(d["c"].rlike("[0-9]"), (d["n"] % 10).cast("string")).when(d["c"].rlike("[a-z]"), _letter(F.pmod(d["n"], letters))).otherwise(F.upper(_letter(F.pmod(d["n"], letters))))
    return F.array_join(F.transform(drawn, one), "")


def _name(e: Column) -> Column:
    """A first name of the gender, with more syllables once it was drawn again, or a surname; in the script and case of e."""
    out = F.lit(None).cast("string")
    for script, pattern in (("Cyrillic", r"\p{IsCyrillic}"), ("Greek", r"\p{IsGreek}"), ("Latin", None)):
        firsts = F.create_map(*[y for g, names in FIRST[script].items() for y in (F.lit(g), F.array(*map(F.lit, names)))])
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        made = F.initcap(F.array_join(F.transform(F.sequence(F.lit(2), F.lit(5) + e["attempt"]), lambda i: F.element_at(syllables, _nth(e["h"], i, 16) + 1)), ""))
        first = F.concat(F.element_at(F.element_at(firsts, e["gender"]), _nth(e["h"], F.lit(1), 8) + 1), F.when(e["attempt"] > 0, F.concat(F.lit("-"), made)).otherwise(""))
        name = F.when(e["kind"] == "first", first).otherwise(made)
        out = F.when(e["x"].rlike(pattern), name).otherwise(out) if pattern else F.coalesce(out, name)
    return bound(out, lambda n: F.when((F.length(e["x"]) > 1) & (e["x"] == F.upper(e["x"])), F.upper(n)).otherwise(n))


def _email(e: Column, key: str) -> Column:
    low = F.lower(e["x"])
    label = bound(_hex(key, F.lit("host"), F.substring_index(low, "@", -1)), lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: _letter(_nth(h, i, 26))), ""))
    tail = F.when(e["attempt"] > 0, F.concat(F.lit("."), F.substring(e["h"], 1, 6))).otherwise("")
    made = F.concat(_redrawn(F.substring_index(low, "@", 1), e["h"]), tail, F.lit("."), F.substring(e["h"], 7, 6), F.lit("@"), label, F.lit(".example.org"))
    return bound(made, lambda m: F.when((e["x"] == F.upper(e["x"])) & (e["x"] != low), F.upper(m)).otherwise(m))


def _checked_card(plain: Column) -> Column:
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    return F.concat(body, ((10 - luhn(F.concat(F.regexp_replace(body, "[^0-9]", ""), F.lit("0"))) % 10) % 10).cast("string"))


def _checked_iban(plain: Column) -> Column:
    bare = F.replace(plain, F.lit(" "), F.lit(""))
    digits = 98 - mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 2), F.lit("00")))
    return F.concat(F.substring(plain, 1, 2), F.lpad(digits.cast("string"), 2, "0"), F.substring(plain, F.lit(5), F.length(plain)))


def surrogates(parts: Column, key: str, known) -> Column:
    """Replacements of parts, in order; known(canon) is a struct of attempt, over 0 if the entity collided, and gender by the corpus, or null."""
    tried = F.transform(parts, lambda e: F.struct(*(e[c].alias(c) for c in ("x", "kind", "gender", "canon")), known(e["canon"]).alias("known")))
    sure = F.transform(tried, lambda e: F.struct(*(e[c].alias(c) for c in ("x", "kind", "canon")), F.coalesce(e["known"]["gender"], e["gender"]).alias("gender"), F.coalesce(e["known"]["attempt"], F.lit(0)).alias("attempt")))
    hashed = F.transform(sure, lambda e: F.struct(*(e[c].alias(c) for c in ("x", "kind", "gender", "attempt")), _hex(key, e["canon"], e["attempt"].cast("string")).alias("h")))

    def one(e: Column) -> Column:
        octet = lambda i, n, base: (_nth(e["h"], F.lit(i), n) + base).cast("string")
        wide = e["attempt"] >= WIDE
        keep = F.when(e["kind"] == "iban", 2).when(e["kind"] == "card", 1).when(e["kind"] == "phone", F.length(F.regexp_extract(e["x"], r"^\+\d{1,3}(?=[ (.-])", 0))).otherwise(0)
        plain = bound(keep, lambda k: _redrawn(e["x"], e["h"], k))
        ip = F.when(wide, F.concat(F.lit("2001:db8::"), F.substring(e["h"], 1, 4), F.lit(":"), F.substring(e["h"], 5, 4))).otherwise(F.concat_ws(".", octet(1, 16, 240), octet(2, 256, 0), octet(3, 256, 0), octet(4, 254, 1)))
        more = F.when(wide, F.concat(F.lit("-"), F.substring(e["h"], 1, 8))).otherwise("")
        return (
            F.when(e["kind"] == "email", _email(e, key)).when(e["kind"] == "ip", ip).when(e["kind"].isin("first", "last"), _name(e)).when(e["kind"] == "card", F.concat(bound(plain, _checked_card), more)).when(e["kind"] == "iban", F.concat(bound(plain, _checked_iban), more)).when(e["kind"] == "ssn", F.concat(F.overlay(plain, F.lit("9"), F.lit(1)), more)).otherwise(F.concat(plain, more))
        )

    return F.transform(hashed, one)


def found(text: Column) -> Column:
    """All entities of a text in order, repeats included."""
    hint = text.rlike("[0-9@]")
    for word in HINTS:
        hint = hint | F.contains(text, F.lit(word))
    return F.when(hint, F.regexp_extract_all(text, F.lit(ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(mentions: DataFrame) -> DataFrame:
    """Of mentions (canon, x, kind, gender): one row per canon with a mention x and its gender, n where honorifics differ or none tells; mixed if mentions differ."""
    told = F.when(F.col("gender") != "n", F.col("gender"))
    got = mentions.groupBy("canon", "kind").agg(F.min("x").alias("x"), F.min(told).alias("lo"), F.max(told).alias("hi"), (F.min("gender") != F.max("gender")).alias("mixed"))
    return got.select("canon", "kind", "x", F.when(F.col("kind") != "first", "").when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("n").alias("gender"), "mixed")


def redrawn(table: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """entities() with the attempt at which none has another's surrogate or one that is a real entity."""
    table = table.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        table = cut(table)
        part = F.array(F.struct("x", "kind", "gender", "canon"))
        new = surrogates(part, key, lambda _: F.struct(F.col("attempt").alias("attempt"), F.col("gender").alias("gender")))
        drawn = cut(table.select("canon", canon(F.col("kind"), F.element_at(new, 1)).alias("to")))
        first = drawn.groupBy("to").agg(F.min("canon").alias("first"), F.count(F.lit(1)).alias("n"))
        many = drawn.join(first.where("n > 1"), "to").where("canon <> first").select("canon")
        real = drawn.join(table.select(F.col("canon").alias("to")), "to", "left_semi").select("canon")
        bad = cut(many.unionByName(real).distinct())
        if bad.isEmpty():
            return table
        table = table.join(bad.withColumn("again", F.lit(1)), "canon", "left").select("canon", "kind", "x", "gender", "mixed", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    raise RuntimeError("surrogates still collide")


def pseudonymised(docs: DataFrame, key: str = "kestrine", text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text column, and n_entities long (a column of that name is replaced); all other columns stay, whatever their names.

    Null texts stay null with 0 entities; texts without entities stay as they
    are, however long; repeated rows get equal texts; an empty table gives an
    empty result.
    """
    hits = docs.select(F.xxhash64(text_col).alias("text_key"), F.array_distinct(found(F.col(text_col))).alias("xs")).where(F.size("xs") > 0)
    parts = F.flatten(F.transform(F.filter(described(F.col("xs")), lambda e: ~e["stays"]), lambda e: e["parts"]))
    mentions = cut(hits.select("text_key", F.explode(parts).alias("p")).select("text_key", "p.*").distinct())
    known = cut(redrawn(entities(mentions), key).where("attempt > 0 or (kind = 'first' and mixed)").select("canon", F.struct("attempt", "gender").alias("known")))
    n_known = known.count()

    text = F.col("row_").getField(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row_"))
    out = rows.withColumns({"xs_": found(text), "known_": F.lit(None).cast("map<string, struct<attempt: int, gender: string>>")})
    if n_known:
        by_text = mentions.join(known, "canon").groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("canon", "known"))).alias("known_"))
        by_text = F.broadcast(by_text) if n_known + by_text.count() <= BROADCAST_REDRAWN else by_text
        out = out.drop("known_").join(by_text, F.xxhash64(text) == F.col("text_key"), "left")
    out = out.withColumn("es_", described(F.col("xs_")))
    one = lambda e, x: F.when(e["stays"], x).otherwise(F.concat(e["head"], F.array_join(surrogates(e["parts"], key, lambda c: F.try_element_at(F.col("known_"), c)), " ")))
    weave = lambda new: F.array_join(F.transform(F.split(text, ALL, -1), lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.lit("")))), "")
    woven = bound(F.transform(F.col("es_"), lambda e, i: one(e, F.get(F.col("xs_"), i))), weave)
    changed = F.when(F.size("es_") > 0, woven).otherwise(text)
    n = F.size(F.filter(F.col("es_"), lambda e: ~e["stays"])).cast("long")
    return out.select(*(changed.alias(c) if c == text_col else F.col("row_").getField(c).alias(c) for c in docs.columns if c != "n_entities"), n.alias("n_entities"))
