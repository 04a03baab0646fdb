"""Personal data: surrogate generation.

Entities (e-mail, IP, MAC, card or account number, IBAN, phone, social security number, secret, person name) are found by one pattern and
replaced by keyed surrogates: an HMAC under a secret key drives the new digits and letters, and the entity's format, check digits, case, script and the
gender of a given name stay. An entity has the same surrogate in all documents, however it is punctuated; a person's names are
replaced where they stand alone in the document as well. All different entities are checked: where two would share a
surrogate, or a surrogate is some other real entity, the later one is hashed again, until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, packed, small, stage_out, table, text_id

# Titles and given names by gender and script, and phrases that a name follows. Other names can be given as a parameter.
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora", "г-н", "г-жа"]
GIVEN = [
    ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Anthony", "Steven", "Andrew", "Kenneth", "Joshua", "Pierre", "Jean", "Hans", "Klaus", "Jürgen", "Carlos", "Javier", "Miguel", "Ahmed", "Mohammed", "Hiroshi", "Rahul", "Wei"],
    ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Nancy", "Margaret", "Sandra", "Ashley", "Emily", "Michelle", "Marie", "Claire", "Sabine", "Ursula", "Helga", "Carmen", "Lucía", "Isabel", "Fatima", "Aisha", "Yuki", "Priya", "Mei"],
    ["Иван", "Сергей", "Дмитрий", "Алексей", "Николай", "Михаил", "Андрей", "Павел"],
    ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
]
CUES = ["name is", "name:", "contact:", "author:", "signed:", "dear"]
SYLLABLES = ["bal", "cor", "den", "fal", "gar", "hol", "jen", "kin", "lor", "mar", "nor", "per", "ros", "sel", "tor", "ven"]
CYRILLIC = ["бал", "кор", "ден", "фал", "гар", "хол", "жен", "кин", "лор", "мар", "нор", "пер", "рос", "сел", "тор", "вен"]

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_NAME = r"\p{Lu}(?:\p{L}+(?:-\p{L}+)*(?:['’]\p{L}{2,})?|['’]\p{L}{2,})"
#: A word that may be a person's name standing alone.
_ALONE = rf"(?<![\p{{L}}\p{{N}}'’-]){_NAME}"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}_+-][\p{L}\p{N}._+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-]{16})(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_/+-]++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "hex": r"(?<![\p{L}\p{N}:-])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}|(?=[A-Fa-f:]{0,39}[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?:(?::[0-9A-Fa-f]{1,4}){1,6}|:))(?![\p{L}\p{N}:])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?<!(?i:\bv|\bver|\bversion|\brelease)[. ]{{1,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9]{4}(?:(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
}
_AT_WORD, _AT_NUMBER = ("email", "secret", "iban", "hex"), ("ip", "phone", "ssn", "card")


def entity_pattern(given: list[list[str]] = GIVEN) -> str:
    """One pattern for all entities; a look at the sign and the sign before decides which kinds are tried at a place."""
    led = rf"(?:{'|'.join(TITLES)})\.? |(?:{'|'.join(x for names in given for x in names)}) "
    cued = rf"(?<=\b(?i:{'|'.join(CUES)}) ){_NAME} {_NAME}"
    name = rf"(?=[\p{{Lu}}г])(?:(?:{led}){_NAME}(?: {_NAME}){{0,2}}|{cued}(?: {_NAME})?)"
    return (
        rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{L}}\p{{N}}_/+-])(?:{'|'.join(PATTERNS[k] for k in _AT_WORD)}|{name})"
        rf"|(?<![0-9])(?=[0-9+(])(?:{'|'.join(PATTERNS[k] for k in _AT_NUMBER)})"
    )


def _width() -> Column:
    """What a row with an entity's normal form counts for when a side is measured for broadcasting."""
    return 1 + F.char_length("norm") / 32



_ENTITIES = "array<struct<raw:string,kind:string,norm:string>>"


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$") | m.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}|^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$"), "hex")
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^(?:\+|\()|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(m.rlike(r"^[0-9][0-9 -]+$") & (F.char_length(F.regexp_replace(m, "[^0-9]", "")) <= 19), "card")
        .when(m.rlike(rf"^(?:{'|'.join(TITLES)}|{_NAME})\.? {_NAME}"), "name")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2} ?[A-Z0-9 ]+$") & (F.char_length(F.regexp_replace(m, " ", "")) <= 34), "iban")
        .otherwise("secret")
    )


def _norm(m: Column, kind: Column) -> Column:
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(m, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind.isin("email", "hex"), F.lower(m)).otherwise(m)


def entities(text: Column, pattern: str) -> Column:
    """The entities of a text in order: raw, kind, norm."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    found = F.transform(found, lambda m: F.struct(m.alias("raw"), _kind(m).alias("kind")))
    found = F.transform(found, lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"), _norm(e["raw"], e["kind"]).alias("norm")))
    return F.coalesce(found, F.array().cast(_ENTITIES))


def _is_title(t: Column) -> Column:
    return F.regexp_replace(t, r"\.$", "").isin(TITLES)


def _is_given(t: Column, given: list[list[str]]) -> Column:
    return F.array_contains(F.expr(f"array({', '.join(_quoted(x) for names in given for x in names)})"), F.initcap(t))


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _names(found: Column) -> Column:
    """The words of persons' names among entities, without titles, as they are written."""
    return F.flatten(F.transform(F.filter(found, lambda e: e["kind"] == "name"), lambda e: F.filter(F.split(e["raw"], " "), lambda t: ~_is_title(t))))


def keys(found: Column, given: list[list[str]] = GIVEN) -> Column:
    """What surrogates are given to, of an array of entities: (kind, norm); a name's words one by one."""
    pair = lambda kind, norm: F.struct(kind.alias("kind"), norm.alias("norm"))
    plain = F.transform(F.filter(found, lambda e: e["kind"] != "name"), lambda e: pair(e["kind"], e["norm"]))
    surnames = F.transform(F.filter(_names(found), lambda t: ~_is_given(t, given)), lambda t: pair(F.lit("surname"), F.lower(t)))
    return F.array_distinct(F.concat(plain, surnames))


def people(text: Column, found: Column) -> Column:
    """Lower-case words of the names in a text that stand for the person wherever they are written with a capital; not words that the text has in lower case too."""
    words = F.array_distinct(F.transform(_names(found), F.lower))
    return F.filter(words, lambda w: ~F.contains(text, F.concat(F.lit(" "), w, F.lit(" "))))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _spread(stream: Column, like: Column, digits: str = "0123456789") -> Column:
    """`like` with its letters and digits replaced by those of a hex stream, place by place; case and other signs stay."""
    def put(c: Column, i: Column) -> Column:
        at = F.substring(stream, (i % 64 + 1).cast("int"), F.lit(1))
        letter = F.translate(at, "0123456789", "ghijkmnpqr")
        return F.when(c.rlike("[0-9]"), F.translate(at, "abcdef", "012345")).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(like, ""), put), "")


def _keyed(secret: str, *parts: Column) -> Column:
    """HMAC-SHA-256 of the parts under the secret, as 64 hex digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in key)), F.concat_ws("|", *parts).cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def _surname(norm: Column, attempt: Column, secret: str) -> Column:
    stream = _keyed(secret, F.lit("surname"), norm, attempt.cast("string"))
    # a hex digit picks each of four syllables; later attempts get letters more, so that names can't run out
    syllables = lambda names: F.concat(*[F.element_at(F.expr(f"array({', '.join(map(_quoted, names))})"), F.conv(F.substring(stream, k, 1), 16, 10).cast("int") + 1) for k in (1, 2, 3, 4)])
    more = F.when(attempt >= 2, F.translate(F.substring(stream, 33, 6), "0123456789", "ghijkmnpqr")).otherwise(F.lit(""))
    return F.concat(F.when(norm.rlike(r"\p{IsCyrillic}"), syllables(CYRILLIC)).otherwise(syllables(SYLLABLES)), more)


def new_norm(kind: Column, norm: Column, attempt: Column, secret: str) -> Column:
    """The surrogate's normal form. Under one key it depends on kind, normal form and attempt alone."""
    stream = _keyed(secret, kind, norm, attempt.cast("string"))
    digits = F.substring(F.concat(F.translate(stream, "abcdef", "012345")), F.lit(1), F.char_length(norm))
    tail = lambda s, n: F.substring(s, F.lit(n + 1), F.char_length(s))
    first = F.translate(F.substring(stream, 64, 1), "0123456789abcdef", "2345678923456789")
    # card: the issuer's digit stays; valid check digits are made anew
    card = F.concat(F.substring(norm, 1, 1), tail(digits, 1))
    body = F.substring(card, F.lit(1), F.char_length(card) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    card = F.when(_luhn(norm) == 0, F.concat(body, check.cast("string"))).otherwise(card)
    national = F.concat(first, tail(digits, 1))
    phone = F.when(F.char_length(norm) <= 10, national).when(norm.rlike("^[17]"), F.concat(F.substring(norm, 1, 1), first, tail(digits, 2))).otherwise(F.concat(F.substring(norm, 1, 2), first, tail(digits, 3)))
    octet = lambda k: (F.conv(F.substring(stream, 2 * k + 1, 2), 16, 10).cast("int") % 254 + 1).cast("string")
    # ip: private ranges stay private
    inside = norm.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    ip = F.concat_ws(".", F.when(inside | norm.rlike(r"^(?:10|127)\."), F.substring_index(norm, ".", 1)).otherwise(octet(0)), F.when(inside, F.element_at(F.split(norm, r"\."), 2)).otherwise(octet(1)), octet(2), octet(3))
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    domain = F.concat(F.lit("d"), F.substring(_keyed(secret, F.lit("domain"), domain), 1, 8), F.lit(".example."), F.when(domain.rlike(r"\.(?:com|net|org)$"), F.substring_index(domain, ".", -1)).otherwise(F.lit("com")))
    longer = F.when(attempt >= 2, F.substring(stream, 33, 12)).otherwise(F.lit(""))  # short forms can't run out
    email = F.concat(_spread(stream, local), longer, F.lit("@"), domain)
    country, bban = F.substring(norm, 1, 2), _spread(stream, tail(norm, 4))
    code = lambda c: (F.ascii(c) - 55).cast("string")
    number = F.concat(bban, code(F.substring(country, 1, 1)), code(F.substring(country, 2, 1)), F.lit("00"))
    proof = F.when(bban.rlike("^[0-9]{11,30}$"), F.lpad((98 - number.cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")).otherwise(F.translate(F.substring(stream, 1, 2), "abcdef", "234567"))
    hexes = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c.rlike("[0-9a-fA-F]"), F.substring(stream, (i % 64 + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    pure_hex = F.when(norm.rlike("^[0-9a-f]+$"), hexes).when(norm.rlike("^[0-9A-F]+$"), F.upper(hexes)).otherwise(_spread(stream, norm))
    return (
        F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", national).when(kind == "ip", ip).when(kind == "email", email)
        .when(kind == "iban", F.concat(country, proof, bban)).when(kind == "hex", hexes).when(kind == "surname", _surname(norm, attempt, secret)).otherwise(pure_hex)
    )


def _dress(raw: Column, kind: Column, new: Column) -> Column:
    """A surrogate's normal form in the format of the entity it stands for."""
    place = lambda i: F.char_length(F.regexp_replace(F.substring(raw, F.lit(1), i), "[^0-9A-Za-z]", "")) + 1
    signs = F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, place(i).cast("int"), F.lit(1))).otherwise(c)), "")
    upper = raw.rlike(r"\p{Lu}") & ~raw.rlike(r"\p{Ll}")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), signs).when(kind.isin("email", "hex") & upper, F.upper(new)).otherwise(new)


def turned_names(names: list[str], secret: str) -> dict[str, str]:
    """Each given name's surrogate: the next one in a ring whose order the key decides."""
    ring = sorted(names, key=lambda x: hmac.new(secret.encode(), x.encode(), "sha256").digest())
    return dict(zip(ring, ring[1:] + ring[:1], strict=True))


def _renamed_word(t: Column, attempt_of, secret: str, given: list[list[str]]) -> Column:
    """One word of a person's name: a title stays, a given name changes within its gender and script, others are surnames; case stays."""
    rings = {k: v for names in given for k, v in turned_names(names, secret).items()}
    turned = F.try_element_at(F.expr(f"map({', '.join(f'{_quoted(k)}, {_quoted(v)}' for k, v in rings.items())})"), F.initcap(t))
    surname = F.initcap(_surname(F.lower(t), attempt_of(F.lit("surname"), F.lower(t)), secret))
    new = F.coalesce(turned, surname)
    return F.when(_is_title(t), t).when(t == F.upper(t), F.upper(new)).otherwise(new)


def _renamed(raw: Column, attempt_of, secret: str, given: list[list[str]]) -> Column:
    return F.array_join(F.transform(F.split(raw, " "), lambda t: _renamed_word(t, attempt_of, secret, given)), " ")


def _zipped(between: Column, new: Column) -> Column:
    """Pieces of a text with the replacements between them."""
    return F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def exceptions(all_keys: DataFrame, secret: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate was taken: by another entity's, or as a real entity."""
    attempt = F.lit(0)
    given = stage_out(all_keys.distinct().withColumn("attempt", attempt), "pii-entities")
    given = given.withColumn("new", new_norm(F.col("kind"), F.col("norm"), F.col("attempt"), secret))
    given = stage_out(given, "pii-surrogates")
    real = given.select(F.col("kind").alias("k"), F.col("norm").alias("r"))
    while True:
        first = given.groupBy(F.col("kind").alias("k"), F.col("new").alias("s")).agg(F.min(F.struct("attempt", "norm")).alias("owner"), F.count("*").alias("c")).where("c > 1")
        late = given.join(first, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("s"))).where((F.col("norm") != F.col("owner.norm"))).select("kind", "norm")
        taken = given.join(real, (F.col("kind") == F.col("k")) & (F.col("new") == F.col("r")), "left_semi").select("kind", "norm")
        again = stage_out(late.union(taken).distinct().withColumn("again", F.lit(True)), "pii-again")
        if again.isEmpty():
            return given.where("attempt > 0").select("kind", "norm", "attempt")
        given = given.join(small(again, weight=_width()), ["kind", "norm"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)).drop("again")
        given = given.withColumn("new", F.when(F.col("attempt") > 0, new_norm(F.col("kind"), F.col("norm"), F.col("attempt"), secret)).otherwise(F.col("new")))
        given = stage_out(given, "pii-surrogates")


def surrogate(docs: DataFrame, secret: str, keep: list[str] | None = None, text_col: str = "text", given: list[list[str]] = GIVEN) -> DataFrame:
    """docs (or its columns in `keep`) with the text column rewritten and pii_entities (how many were replaced); one row per input row.

    A null text stays null, a text without entities stays as it is, byte for byte; texts are read whole, however long, and
    repeated rows get equal texts. An input column named pii_entities is replaced, others keep their names. An empty table gives
    an empty result. The same key gives the same surrogates in every run over the same entities; an empty key is refused.
    `given` lists given names, a list for each gender and script; other persons are found by titles and cues.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    pattern = entity_pattern(given)
    kept = [c for c in only(docs, keep) if c.lower() not in {"pii_entities", text_col.lower()}]
    row = packed(kept)
    body = docs.select(row.alias("row"), F.col(text_col).alias("t"))
    odd = exceptions(body.select(entities(F.col("t"), pattern).alias("found")).select(F.explode(keys(F.col("found"), given)).alias("x")).select("x.*"), secret)
    held = body.withColumn("found", entities(F.col("t"), pattern))
    if odd.isEmpty():
        held, attempt_of = held.withColumn("odd", F.lit(None)), lambda kind, norm: F.lit(0)
    else:  # texts with such an entity get a map of their attempts
        odd = odd.withColumnRenamed("attempt", "a")
        texts = held.where(F.size("found") > 0).select(text_id(F.col("t")).alias("h"), F.explode(keys(F.col("found"), given)).alias("x")).select("h", "x.kind", "x.norm")
        by_text = texts.join(small(odd, weight=_width()), ["kind", "norm"]).distinct().groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "a"))).alias("odd"))
        by_text = small(stage_out(by_text, "pii-odd"), weight=1 + 4 * F.size("odd"))
        held = held.withColumn("th", text_id(F.col("t"))).join(by_text, F.col("th") == F.col("h"), "left")
        attempt_of = lambda kind, norm: F.coalesce(F.try_element_at(F.col("odd"), F.concat_ws("|", kind, norm)), F.lit(0))
    new = F.transform(
        "found",
        lambda e: F.when(e["kind"] == "name", _renamed(e["raw"], attempt_of, secret, given)).otherwise(_dress(e["raw"], e["kind"], new_norm(e["kind"], e["norm"], attempt_of(e["kind"], e["norm"]), secret))),
    )
    between = F.when(F.size("found") > 0, F.split(F.col("t"), pattern, -1))
    held = held.withColumns({"new": new, "between": between, "people": people(F.col("t"), F.col("found"))})
    # names that stand alone, in the pieces between the entities of texts with persons
    alone = lambda piece: F.regexp_extract_all(piece, F.lit(f"({_ALONE})"), F.lit(1))
    known = lambda w: F.array_contains(F.col("people"), F.lower(w))
    again = lambda piece: _zipped(F.split(piece, _ALONE, -1), F.transform(alone(piece), lambda w: F.when(known(w), _renamed_word(w, attempt_of, secret, given)).otherwise(w)))
    some = F.size("people") > 0
    pieces = F.when(some, F.transform("between", again)).otherwise(F.col("between"))
    more = F.when(some, F.size(F.filter(F.flatten(F.transform("between", alone)), known))).otherwise(0)
    held = held.withColumns({"out": F.when(F.size("found") > 0, _zipped(pieces, F.col("new"))).otherwise(F.col("t")), "n": (F.size("found") + more).cast("long")})
    names = [f"row.`{c}`" for c in kept]
    if text_col.lower() in {c.lower() for c in only(docs, keep)}:
        at = [c.lower() for c in only(docs, keep) if c.lower() != "pii_entities"].index(text_col.lower())
        names.insert(at, F.col("out").alias(text_col))
    return held.select(*names, F.col("n").alias("pii_entities"))


#: The session's setting with the key; without it a query draws a key of its own, which nobody keeps.
KEY_SETTING = "spark.sparkfrontier.pii.key"


def op4_pii_surrogates(spark, sf_dir):
    return surrogate(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32), keep=["doc_id", "text"])


QUERIES = {"op4_pii_surrogates": op4_pii_surrogates}
ORACLE_SQL: dict[str, str] = {}
