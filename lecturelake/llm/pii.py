"""Personal data replaced by surrogates, in DataFrame functions alone.

Entities are found by patterns; each distinct one gets a keyed surrogate of its own type, script, case and format, the
same wherever it occurs. Surrogates that fall together, or on something that is itself an entity of the corpus, are
drawn again until none does. Names are taken apart: a given name and a family name have surrogates of their own, no two
the same, so that "Mr. X" and "Mr. Y X" keep their name in common and two persons stay two. Cards and IBANs count, and
are replaced, with right check digits only.
"""

from __future__ import annotations

import hashlib
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: Given names by gender; a name of a list is replaced by another one of it. Names without a title count if they begin with
#: one of these. Fixed values.
GIVEN = {
    "female": ["Alice", "Anna", "Carla", "Claire", "Elena", "Emma", "Greta", "Hanna", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marie", "Nora", "Paula", "Rosa", "Sarah", "Sofia", "Vera"],
    "male": ["Adam", "Carlos", "David", "Diego", "Emil", "Felix", "Frank", "Henri", "Hugo", "James", "Jean", "John", "Jonas", "Karl", "Louis", "Luis", "Marco", "Otto", "Paul", "Pedro"],
}
TITLES = {"female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"], "male": ["Mr", "Herr", "Monsieur", "Señor", "Sr"], "any": ["Dr", "Prof"]}
_titles = "|".join(t for x in TITLES.values() for t in x)
_given = "|".join(n for x in GIVEN.values() for n in x)

#: Types in the order in which they are tried at a place.
PATTERNS = {
    "email": r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-])?@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    "secret": r"(?<=(?i:token|secret|api[_-]?key|passw(?:or)?d)\s{0,3}[=:]\s{0,3}[\x22']?)(?=[_/+-]*[A-Za-z0-9])[A-Za-z0-9_/+-]{8,}|(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\p{N}+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\p{N}+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "name": rf"(?<![\p{{L}}])(?=[A-Z])(?:(?:{_titles})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,2}}|(?:{_given})(?: \p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?){{1,2}}(?!\p{{L}}))",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes.
MAYBE = rf"[@0-9]|(?i:token|secret|key|passw)|(?<![\p{{L}}])(?=[A-Z])(?:(?:{_titles})\.? |(?:{_given}) \p{{Lu}})"

#: Letters and digits change places within their class, so script, case, vowels and format stay.
CLASSES = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ",
    "абвгдежзийклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]


def _members(first: int, last: int, category: str) -> str:
    """Letters of a category in a range of code points."""
    return "".join(c for c in map(chr, range(first, last + 1)) if unicodedata.category(c) == category)


#: Other letters and digits by pattern, first match first: members of their script and case, or, for scripts without a
#: line of their own, Latin letters and digits, so that no letter or digit is without a replacement.
SCRIPTS = {
    r"[\p{IsLatin}&&\p{Ll}]": _members(0xDF, 0x17F, "Ll"), r"[\p{IsLatin}&&\p{Lu}]": _members(0xC0, 0x17F, "Lu"),
    r"[\p{IsCyrillic}&&\p{Ll}]": _members(0x430, 0x45F, "Ll"), r"[\p{IsCyrillic}&&\p{Lu}]": _members(0x400, 0x42F, "Lu"),
    r"[\p{IsGreek}&&\p{Ll}]": _members(0x3AC, 0x3CE, "Ll"), r"[\p{IsGreek}&&\p{Lu}]": _members(0x386, 0x3AB, "Lu"),
    r"[\p{IsArmenian}&&\p{Ll}]": _members(0x561, 0x586, "Ll"), r"[\p{IsArmenian}&&\p{Lu}]": _members(0x531, 0x556, "Lu"),
    r"\p{IsGeorgian}": _members(0x10D0, 0x10F0, "Lo") or _members(0x10D0, 0x10F0, "Ll"),
    r"\p{IsHangul}": _members(0xAC00, 0xD7A3, "Lo")[::7], r"\p{IsHan}": _members(0x4E00, 0x9FA5, "Lo")[::8],
    r"\p{IsHiragana}": _members(0x3042, 0x3093, "Lo"), r"\p{IsKatakana}": _members(0x30A2, 0x30F3, "Lo"),
    r"[\p{IsHebrew}&&\p{L}]": _members(0x5D0, 0x5EA, "Lo"), r"[\p{IsArabic}&&\p{L}]": _members(0x627, 0x64A, "Lo"),
    r"[\p{IsDevanagari}&&\p{L}]": _members(0x905, 0x939, "Lo"), r"[\p{IsBengali}&&\p{L}]": _members(0x985, 0x9B9, "Lo"),
    r"[\p{IsTamil}&&\p{L}]": _members(0xB85, 0xBB9, "Lo"), r"[\p{IsTelugu}&&\p{L}]": _members(0xC05, 0xC39, "Lo"),
    r"[\p{IsThai}&&\p{L}]": _members(0xE01, 0xE2E, "Lo"), r"[\p{IsEthiopic}&&\p{L}]": _members(0x1208, 0x1357, "Lo"),
    r"\p{N}": CLASSES[0], r"\p{Lu}": CLASSES[4], r"\p{L}": CLASSES[2],
}
#: Attempts at each length; then a surrogate gets one more character, as its space may be exhausted.
ATTEMPTS = 4
HEX = ["0123456789", "abcdef", "ABCDEF"]
DIGITS = ("phone", "ssn", "card")


def next_given(key: str) -> dict[str, str]:
    """Each listed given name's successor in a keyed order of its list, the first following the last."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).hexdigest())
        out |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return out


def kind_of(entity: Column) -> Column:
    """The first type whose pattern an entity has; a secret is what no other pattern matches whole."""
    out = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What is the same for mentions of one entity: digits without format, addresses without case."""
    plain = F.when(kind.isin(*DIGITS), F.regexp_replace(entity, "[^0-9]", "")).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
    return plain.when(kind == "email", F.lower(entity)).otherwise(entity)


def remainder97(iban: Column) -> Column:
    """The number that an IBAN without blanks stands for, modulo 97; 1 if its check digits are right."""
    chars = F.filter(F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), ""), lambda c: c != "")
    digit = lambda a, c: (a * 10 + c.cast("int")) % 97
    letter = lambda a, c: (a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), digit(a, c)).otherwise(letter(a, c)))


def luhn_digit(body: Column) -> Column:
    """The digit that makes a card number of the digits before it."""
    chars = F.reverse(F.filter(F.split(body, ""), lambda c: c != ""))
    twice = lambda d: F.floor(2 * d / 10).cast("int") + 2 * d % 10
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int")))
    return ((10 - F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10) % 10).cast("string")


def is_entity(kind: Column, canon: Column) -> Column:
    """Whether check digits, where a type has them, are right."""
    return F.when(kind == "card", F.expr("luhn_check(canon)")).when(kind == "iban", remainder97(canon) == 1).otherwise(True)


def parts(kind: Column, entity: Column, canon: Column) -> Column:
    """array<struct<kind, canon, before>>: what has surrogates of its own in an entity, and what stands before each. Of a
    name's words the last is the family name and those before are given names; a title stays."""
    title = F.regexp_extract(entity, rf"^((?:{_titles})\.? )", 1)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    role = lambda i: F.when(i == F.size(words) - 1, "family").otherwise("given")
    named = F.transform(words, lambda w, i: F.struct(role(i).alias("kind"), w.alias("canon"), F.when(i == 0, title).otherwise(" ").alias("before")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon"), F.lit("").alias("before"))))


def draw(seed: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that a keyed seed picks."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("long") % n


def shifted(c: Column, seed: Column, classes: list[str]) -> Column:
    """Another member of the class, or else of the script, that a letter or digit is in; other characters stay."""
    found = F.lit(None).cast("string")
    for pattern in reversed(SCRIPTS):
        found = F.when(c.rlike(f"^{pattern}$"), F.lit(SCRIPTS[pattern])).otherwise(found)
    found = F.when(c.rlike(r"^[\p{L}\p{N}]$"), found)
    for members in classes:
        found = F.when(F.instr(F.lit(members), c) > 0, F.lit(members)).otherwise(found)
    drawn = F.transform(F.array(found), lambda m: F.substring(m, (draw(seed, F.length(m)) + 1).cast("int"), F.lit(1)))
    return F.coalesce(F.get(drawn, F.lit(0)), c)


def longer(text: Column, n: Column) -> Column:
    """A text with its last letter or digit (without any: a 0) n times more at its end."""
    last = F.regexp_extract(text, r"([\p{L}\p{N}])[^\p{L}\p{N}]*$", 1)
    return F.concat(text, F.repeat(F.when(last == "", "0").otherwise(last), n))


def respelled(text: Column, seed: Column, classes: list[str] = CLASSES) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: shifted(c, F.concat_ws("|", seed, i.cast("string")), classes)), "")


def surrogate(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """A keyed surrogate of a canonical entity, a character longer after every ATTEMPTS attempts."""
    more = F.floor(attempt / ATTEMPTS).cast("int")
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    tail = F.regexp_extract(canon, r"((?:\.[\p{L}\p{N}-]+)?\.\p{L}+)$", 1)  # the last two labels of a domain with three
    head = F.substring(canon, F.lit(1), F.length(canon) - F.length(tail))
    tail = F.when(F.instr(head, "@") > 0, tail).otherwise(F.regexp_extract(canon, r"(\.\p{L}+)$", 1))
    head = F.substring(canon, F.lit(1), F.length(canon) - F.length(tail))
    email = F.concat(respelled(longer(head, more), seed), tail)
    octets = F.array_join(F.transform(F.split(F.concat(canon, F.repeat(F.lit(".0"), more)), r"\."), lambda o, i: (draw(F.concat_ws("|", seed, i.cast("string")), F.when(i == 0, 223).otherwise(255)) + 1).cast("string")), ".")
    country = F.when(kind == "phone", F.substring(canon, F.lit(1), F.greatest(F.lit(0), F.length(canon) - 10))).otherwise(F.substring(canon, 1, 1))
    digits = F.concat(country, respelled(longer(F.substring(canon, F.length(country) + 1, F.length(canon)), more), seed))
    secret = F.when(canon.rlike("^[0-9A-Fa-f]+$"), respelled(longer(canon, more), seed, HEX)).otherwise(respelled(longer(canon, more), seed))
    card = F.substring(digits, F.lit(1), F.length(digits) - 1)
    card = F.concat(card, luhn_digit(card))
    bban = respelled(longer(F.substring(canon, 5, 64), more), seed)
    check = F.lpad((98 - remainder97(F.concat(F.substring(canon, 1, 2), F.lit("00"), bban))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canon, 1, 2), check, bban)
    # of a given name in no list the last letter stays, which often tells the gender
    listed = F.create_map(*[F.lit(x) for pair in next_given(key).items() for x in pair])
    given = F.coalesce(F.get(F.array(F.element_at(listed, canon)), F.lit(0)), F.concat(respelled(longer(F.substring(canon, F.lit(1), F.length(canon) - 1), more), seed), F.right(canon, F.lit(1))))
    out = F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "card", card).when(kind.isin(*DIGITS), digits)
    return out.when(kind == "iban", iban).when(kind == "given", given).when(kind == "family", respelled(longer(canon, more), seed)).otherwise(secret)


def rendered(kind: Column, entity: Column, drawn: Column) -> Column:
    """A canonical surrogate in the format of one mention; digits beyond the format stand at its end."""
    chars = F.filter(F.split(entity, ""), lambda c: c != "")

    def filled(slot: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), f"[^{slot}]", ""))
        put = F.transform(chars, lambda c, i: F.when(c.rlike(f"^[{slot}]$"), F.substring(drawn, (before(i) + 1).cast("int"), F.lit(1))).otherwise(c))
        return F.concat(F.array_join(put, ""), F.substring(drawn, before(F.length(entity)) + 1, F.length(drawn)))

    loud = (entity == F.upper(entity)) & (entity != F.lower(entity))
    return F.when(kind.isin(*DIGITS), filled("0-9")).when(kind == "iban", filled("0-9A-Z")).when((kind == "email") & loud, F.upper(drawn)).otherwise(drawn)


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, drawn: distinct surrogates for distinct entities (kind, canon), none of which is itself an entity.

    Of several entities that draw the same, the least keeps it; the others, and those that draw a real entity, draw
    again with the next attempt, round by round, until no collision is left. That comes to an end, since surrogates
    that keep colliding get longer. Listed given names change places within their lists and come first.
    """
    real = stored(entities.select("kind", "canon").distinct(), "entities")
    listed = (F.col("kind") == "given") & F.col("canon").isin(*next_given(key))
    now, before = real.withColumn("attempt", F.lit(0)), []
    while True:
        drawn = now.withColumn("drawn", surrogate(F.col("kind"), F.col("canon"), key, F.col("attempt"))).withColumn("free", ~listed)
        owner = drawn.groupBy("kind", "drawn").agg(F.min(F.struct("free", "attempt", "canon")).alias("owner"))
        taken = real.select("kind", F.col("canon").alias("drawn"), F.lit(True).alias("is_real"))
        checked = drawn.join(owner, ["kind", "drawn"]).join(taken, ["kind", "drawn"], "left")
        clash = F.col("free") & F.coalesce("is_real", F.lit(False)) | (F.col("owner.canon") != F.col("canon"))
        checked = stored(checked.select("kind", "canon", "attempt", "drawn", clash.alias("clash")), "mapping")
        discard(*before)
        if checked.filter("clash").limit(1).count() == 0:
            discard(real)
            return checked.select("kind", "canon", "drawn")
        now, before = checked.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt")), [checked]


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with entities in text replaced, and n_entities and entity_kinds array<string> added.

    Texts without a possible entity pass straight through; only the others are shuffled, by their own hash, so that
    copies share the work. Names are told by a title, or by a given name of the lists before a capitalized word; digits
    that look like a card's or an IBAN's but fail its check stay as they are. A null text stays null and an empty one empty, with no entities. Repeated rows stay, other
    columns are untouched (columns with the names added are replaced).
    """
    names = [c for c in docs.columns if c not in ("n_entities", "entity_kinds")]
    docs = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    t = F.col(f"c{names.index(text)}")
    found = F.coalesce(t.rlike(MAYBE), F.lit(False))
    clean = docs.filter(~found).withColumn("n_entities", F.lit(0)).withColumn("entity_kinds", F.array().cast("array<string>"))
    dirty = docs.filter(found).withColumn("hits", F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    dirty = dirty.withColumn("h1", F.xxhash64(t)).withColumn("h2", F.length(t))
    each = dirty.select("h1", "h2", F.posexplode("hits").alias("i", "entity")).distinct()
    each = each.withColumn("kind", kind_of(F.col("entity"))).withColumn("canon", canonical(F.col("kind"), F.col("entity"))).filter(is_entity(F.col("kind"), F.col("canon")))
    each = each.select("h1", "h2", "i", F.col("kind").alias("whole"), "entity", F.posexplode(parts(F.col("kind"), F.col("entity"), F.col("canon"))).alias("p", "part"))
    each = stored(each.select("h1", "h2", "i", "p", "whole", "entity", "part.*"), "mentions")
    drawn = mapping(each, key)
    # a name's parts are whole mentions of themselves
    mention = F.when(F.col("whole") == "name", F.col("canon")).otherwise(F.col("entity"))
    shown = each.join(drawn, ["kind", "canon"]).withColumn("shown", F.concat("before", rendered(F.col("kind"), mention, F.col("drawn"))))
    shown = shown.select("h1", "h2", "i", "p", "whole", "shown").repartition("h1", "h2").groupBy("h1", "h2", "i").agg(F.array_join(F.sort_array(F.collect_list(F.struct("p", "shown"))).shown, "").alias("shown"), F.first("whole").alias("kind"))
    lists = shown.groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("i", "shown"))).alias("s"), F.sort_array(F.collect_list(F.struct("i", "kind"))).kind.alias("kinds"))
    met = dirty.join(lists, ["h1", "h2"], "left")
    between = F.split(t, ANY, -1)
    put_in = lambda i: F.coalesce(F.try_element_at("s", i), F.get("hits", i), F.lit(""))
    new = F.array_join(F.transform(between, lambda p, i: F.concat(p, put_in(i))), "")
    put = [F.when(F.col("s").isNotNull(), new).otherwise(t).alias(c) if c == text else F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    kinds = F.coalesce(F.col("kinds"), F.array().cast("array<string>"))
    met = met.select(*put, F.size(kinds).alias("n_entities"), kinds.alias("entity_kinds"))
    return met.unionByName(clean.toDF(*names, "n_entities", "entity_kinds"))
