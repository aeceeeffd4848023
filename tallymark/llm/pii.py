"""Surrogates for personal data, in DataFrame and SQL functions only.

Detected entities (e-mail addresses, phone numbers, card numbers, IPv4 addresses, social
security numbers, and names after an honorific) get keyed replacements of their own type
and format: digits stay digits in the same grouping, a country code stays, a card keeps
its Luhn validity, names keep script and the gender of their honorific.  An entity is
known by its canonical form (digits only, lower case; a phone by its digits after the
country code), so all its mentions get the same surrogate in the format of the mention.
The key enters by HMAC-SHA-256.

Surrogates must be distinct and must not be real entities of the corpus.  Every round
gives the entities that are still unsettled a candidate, keeps the smallest of those that
share one, and re-keys the rest, until all are settled; names and the locals of addresses
grow with the round, so there is always room.  A round settles nearly all that is left;
an error is raised if ``most_rounds`` don't, which only a corpus that uses up the numbers
of a format can cause.  Only distinct entities are shuffled for this; texts wait in the
shared folder.

Defined cases: a null text stays null; rows with equal or null ids stay separate rows; a
text without entities is unchanged; other columns are ignored; a very long text is one
row like any other, and patterns take time in proportion to it, whatever its runs of
letters, digits or dots; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

MALE = "Mr|Herr|Monsieur|M|Señor|Sr|Sir|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Srta|Госпожа"
FIRST = {
    ("male", "latin"): "Adam Bruno Carlo David Erik Felix Georg Henry Ivan Jonas Karl Leo Marco Nils Oscar Paul".split(),
    ("female", "latin"): "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("male", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий".split(),
    ("female", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Зоя Ирина Клара Лариса Мария Нина Ольга Полина Раиса Юлия".split(),
}
SYLLABLES = {
    "latin": "ba be di do fa ga ha ka la le ma mo na ra sa ti".split(),
    "cyrillic": "ба бе ди до фа га ха ка ла ле ма мо на ра са ти".split(),
}
PATTERNS = {
    # A local part starts at the start of its run of characters and never gives any back; a
    # domain has at most 127 labels of 63, so no long run is scanned twice or recursed into.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])",
    "phone": r"(?<![\d\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)",
    "name": rf"(?<![\p{{L}}])(?:{MALE}|{FEMALE})\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity; much cheaper than the patterns.
HINT = rf"@|\d\.\d|\d{{4}}|\d-\d|\b(?:{MALE}|{FEMALE})\.? \p{{Lu}}"
HONORIFIC = rf"^(?:{MALE}|{FEMALE})\.? "
#: Digits of a phone number after its country code.
PHONE_DIGITS = 10


def _kind(x: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(F.regexp_like(x, F.lit(f"^(?:{PATTERNS[kind]})$")), kind).otherwise(out)
    return out


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _gender(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(rf"^(?:{FEMALE})\.? ")), "female").otherwise("male")


def _script(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(r"\p{IsCyrillic}")), "cyrillic").otherwise("latin")


def canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of an entity share.  A name's gender belongs to it; a country code doesn't."""
    name = F.lower(F.regexp_replace(mention, HONORIFIC, ""))
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "ip", mention)
        .when(kind == "phone", F.right(_digits(mention), F.lit(PHONE_DIGITS)))
        .when(kind == "name", F.concat(_gender(mention), F.lit(":"), _script(mention), F.lit(":"), F.size(F.split(name, " ")).cast("string"), F.lit(":"), name))
        .otherwise(_digits(mention))
    )


def _byte(digest: Column, n: int, modulus: int) -> Column:
    return (F.conv(F.substring(digest, 4 * n + 1, 4), 16, 10).cast("int") % modulus).cast("int")


def _pick(names: list[str], digest: Column, n: int) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), _byte(digest, n, len(names)) + 1)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of 16 digits."""
    n = F.transform(F.split(digits, ""), lambda x, i: F.when(i % 2 == 0, F.try_element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), x.cast("int") + 1)).otherwise(x.cast("int")))
    return F.aggregate(n, F.lit(0), lambda a, b: a + b) % 10


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA-256 of a string, in hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def candidate(kind: Column, entity: Column, key: str, round_: int) -> Column:
    """A canonical surrogate of the canonical ``entity``: same type, same shape."""
    digest = keyed(key, F.concat_ws("|", kind, entity, F.lit(str(round_))))
    more = F.translate(F.concat(digest, F.sha2(digest, 256)), "abcdef", "246813")
    phone = F.concat(F.lit("2"), F.substring(more, 1, PHONE_DIGITS - 1))
    bare = F.concat(F.substring(entity, 1, 1), F.substring(more, 1, 14), F.lit("0"))
    # The last digit has weight one, so it can set the sum to anything: valid stays valid.
    check = (F.lit(20) - _luhn(bare) + F.when(_luhn(entity) == 0, 0).otherwise(1 + F.pmod(_byte(digest, 3, 9), F.lit(9)))) % 10
    card = F.concat(F.substring(bare, 1, 15), check.cast("string"))
    ip = F.concat_ws(".", *(((_byte(digest, n, 223) if n == 0 else _byte(digest, n, 254)) + 1).cast("string") for n in range(4)))
    ssn = F.concat(F.lit("9"), F.substring(more, 1, 8))
    user = F.split(F.substring_index(entity, "@", 1), "")
    # Letters stay letters and digits digits, each by a hexadecimal digit of its own.
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(user) / F.lit(64)).cast("int")), lambda i: F.sha2(F.concat_ws("|", digest, i.cast("string")), 256))

    def like(x: Column, h: Column) -> Column:
        letter, digit = F.translate(h, "0123456789abcdef", "bdfhjkmprstvwxyz"), F.translate(h, "abcdef", "246813")
        return F.when(F.regexp_like(x, F.lit("[a-z]")), letter).when(F.regexp_like(x, F.lit("[0-9]")), digit).otherwise(x)

    local = F.array_join(F.zip_with(user, F.split(F.array_join(blocks, ""), ""), like), "")
    tail = F.substring(F.translate(F.sha2(digest, 256), "0123456789abcdef", "bdfhjkmprstvwxyz"), 1, 4 * round_) if round_ else F.lit("")
    email = F.concat(local, tail, F.lit("@example."), F.element_at(F.array(*map(F.lit, ("com", "net", "org"))), _byte(digest, 5, 3) + 1))
    parts = F.split(entity, ":")
    first = F.lit("")
    for (gender, script), names in FIRST.items():
        first = F.when((parts[0] == gender) & (parts[1] == script), _pick(names, digest, 0)).otherwise(first)
    last = F.lit("")
    for script, syllables in SYLLABLES.items():
        last = F.when(parts[1] == script, F.initcap(F.concat(*(_pick(syllables, digest, n) for n in range(1, min(4 + round_, 16)))))).otherwise(last)
    name = F.when(parts[2] == "1", last).otherwise(F.concat_ws(" ", first, last))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "card", card).when(kind == "phone", phone).otherwise(F.concat_ws(":", parts[0], parts[1], parts[2], F.lower(name)))


def surrogates(entities: DataFrame, key: str, most_rounds: int = 40) -> DataFrame:
    """``entities``: distinct (kind, entity).  Returns (kind, entity, surrogate), one to one."""
    left, settled = entities, None
    real = entities.select("kind", F.col("entity").alias("surrogate"))
    for n in range(most_rounds):
        tried = left.withColumn("surrogate", candidate(F.col("kind"), F.col("entity"), key, n))
        free = tried.join(real, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).select("kind", "entity", "surrogate")
        won = materialise(won, "pii-settled")
        settled = won if settled is None else settled.unionByName(won)
        left = materialise(left.join(won.select("kind", "entity"), ["kind", "entity"], "left_anti"), "pii-left")
        if left.isEmpty():
            return settled
    raise RuntimeError(f"surrogates are not settled after {most_rounds} rounds")


def _in_format(kind: Column, mention: Column, surrogate: Column) -> Column:
    """The surrogate as the mention was written: its case, its grouping, its country code."""
    real = F.element_at(F.split(surrogate, ":"), -1)
    digits = _digits(mention)
    code = F.when(kind == "phone", F.substring(digits, F.lit(1), F.length(digits) - PHONE_DIGITS)).otherwise("")
    number = F.split(F.concat(code, real), "")
    empty = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))

    def place(state, x):
        digit = F.regexp_like(x, F.lit(r"\d"))
        return F.struct((state["k"] + F.when(digit, 1).otherwise(0)).alias("k"), F.concat(state["out"], F.when(digit, F.get(number, state["k"])).otherwise(x)).alias("out"))

    shaped = F.aggregate(F.split(mention, ""), empty, place, lambda s: s["out"])
    bare = F.regexp_replace(mention, HONORIFIC, "")
    title = F.regexp_extract(mention, f"({HONORIFIC})", 1)
    name = F.concat(title, F.when(bare == F.upper(bare), F.upper(real)).otherwise(F.initcap(real)))
    email = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(real)).otherwise(real)
    return F.when(kind == "email", email).when(kind == "ip", real).when(kind == "name", name).otherwise(shaped)


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return id_col, text_col with surrogates, n_entities long and kinds (comma-joined, in order)."""
    text = F.col(text_col).cast("string")
    mentions = F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), text.alias("text"), mentions.alias("mentions"))
    held = materialise(found, "pii-texts")
    places = held.where(F.size("mentions") > 0).select("_row", F.posexplode("mentions").alias("n", "mention"))
    places = places.withColumn("kind", _kind(F.col("mention"))).withColumn("entity", canonical(F.col("kind"), F.col("mention")))
    places = materialise(places, "pii-mentions")
    entities = materialise(places.select("kind", "entity").distinct(), "pii-entities")
    named = places.join(surrogates(entities, key), ["kind", "entity"])
    new = named.select("_row", F.struct("n", _in_format(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("new"), "kind").alias("m"))
    lists = new.groupBy("_row").agg(F.array_sort(F.collect_list("m")).alias("m"))
    joined = held.where(F.size("mentions") > 0).join(lists, "_row")
    pieces = F.split("text", ANY, -1)
    woven = F.array_join(F.zip_with(pieces, F.col("m"), lambda a, b: F.concat(a, F.coalesce(b["new"], F.lit("")))), "")
    changed = joined.select(F.col("id").alias(id_col), woven.alias(text_col), F.size("m").cast("long").alias("n_entities"), F.array_join(F.transform("m", lambda x: x["kind"]), ",").alias("kinds"))
    same = held.where(F.coalesce(F.size("mentions") <= 0, F.lit(True))).select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    return changed.unionByName(same)
