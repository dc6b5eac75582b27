"""Personal data replaced by keyed surrogates; DataFrame functions only.

Detected entities (mail addresses, phone numbers, IP addresses, card and social
security numbers, bank accounts, persons after a form of address) get surrogates
of the same type: numbers of as many digits in the same places, cards and
accounts with valid check digits, persons with names of the same gender and
script. A surrogate comes from an HMAC of the entity's canonical form, so all
mentions of an entity get the same one, each in its own format (coreference).
The distinct entities of the corpus are checked against each other: of entities
that drew the same surrogate, or one that is a real entity, all but one draw
again until no collision is left (distinctness).

Every text is searched once; what was found is written with it, and only texts
with an entity are taken apart and moved.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, whole_text

# Forms of address, by gender and language.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "Κυρία"]

# Alphabets in which characters are replaced, and names by script
# and gender.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω"]
_LETTERS = ["[0-9]", "[a-zß-öø-ÿ]", "[а-яё]", "[α-ωά-ώ]"]  # lower-case characters that each alphabet replaces
GIVEN = {
    "m": [
        "Adam Alan Albert Anton Bruno Carl Daniel David Edgar Emil Felix Frank George Gustav Henry Hugo Ivan Jakob James Jonas Karl Leo Louis Lukas Marco Martin Max Oscar Otto Paul Peter Robert Simon Thomas Victor Walter",
        "Алексей Андрей Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Николай Олег Павел Роман Сергей",
        "Αλέξης Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος Στέφανος",
    ],
    "f": [
        "Ada Alice Anna Beatrice Carla Clara Diana Elena Elisa Emma Eva Flora Grace Greta Hanna Helen Ida Irene Julia Karin Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Ruth Sara Sofia Tina Vera Victoria",
        "Алла Анна Вера Галина Дарья Елена Инна Ирина Ксения Лариса Мария Нина Ольга Раиса Софья Тамара",
        "Αγγελική Άννα Βασιλική Δήμητρα Ειρήνη Ελένη Ζωή Κατερίνα Λυδία Μαρία Σοφία Χριστίνα",
    ],
}
FAMILY = {
    "m": [
        "Adler Allen Bauer Becker Bell Bennett Berger Brandt Brooks Carter Clarke Cooper Costa Dubois Ellis Evans Ferrer Fischer Foster Garnier Gibson Graham Haas Harper Hoffman Hughes Jensen Keller Lambert Lang Lopez Marchand Marsh Mercer Moreau Morris Navarro Palmer Parker Pereira Richter Rivera Romero Schulte Soler Torres Turner Vidal Wagner Weber",
        "Антонов Белов Волков Громов Демидов Егоров Жуков Зайцев Карпов Лебедев Макаров Назаров Орлов Павлов Романов Соколов Титов Фролов Чернов Щукин",
        "Αλεξίου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Λαζάρου Μάρκου Νικολάου Οικονόμου Παύλου Στεφάνου Χρήστου",
    ],
}
FAMILY["f"] = [FAMILY["m"][0], " ".join(f"{x}а" for x in FAMILY["m"][1].split()), FAMILY["m"][2]]
#: Syllables that a family name goes on with when the names are used up.
SYLLABLES = [" ".join(c + v for c in cs for v in vs) for cs, vs in (("bdfgklmnprstvz", "aeiou"), ("бвгдзклмнпрст", "аеио"), ("βγδκλμνπρστ", "αειο"))]

#: Attempts after which a surrogate may be longer than its entity: the numbers or
#: addresses of that length count as used up.
ROOM = 3

_TITLE = f"(?:{'|'.join(MALE + FEMALE)})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_ALONE = r"(?<![\p{L}\d])(?<!\d[.,:/+-])"  # before a number that is no part of another
_PHONE = "|".join(
    [
        r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?|\d{1,2}[ .-])?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)",
        # international: without separators, then in groups of 8 to 15 digits together
        r"(?<![\p{L}\d+])\+[1-9]\d{7,14}(?!\d)",
        r"(?<![\p{L}\d+])\+(?=(?:[ ./()-]{0,2}\d){8,15}(?!\d))[1-9]\d{0,2}(?: ?\(\d{1,5}\) ?|[ ./-])\d{1,8}(?:[ ./-]\d{2,8}){0,5}(?!\d)",
        # national: five pairs, an area code before a local part, all in one
        rf"{_ALONE}0\d(?:[ .-]\d{{2}}){{4}}(?!\d)",
        rf"{_ALONE}(?:\(0\d{{1,4}}\) ?\d{{4,8}}|0\d{{1,4}}(?: ?/ ?|[ -])\d{{5,8}})(?![\p{{L}}\d])",
        rf"{_ALONE}(?:0\d{{8,11}}|[2-9]\d{{9}})(?![\p{{L}}\d])(?![.,]\d)",
    ]
)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d])(?<!\d[.+-])(?<![\s][.-])(?<!^[.-])\d(?:[ -]?\d){12,18}(?![\p{L}\d])",
    "phone": _PHONE,
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
}
KINDS = tuple(PATTERNS)
_ANY = "|".join(PATTERNS.values())
#: An entity's pattern can match only a text with one of these.
_HINT = rf"@|\d[\d ./()-]{{5,}}\d|[A-Z]{{2}}\d\d ?[A-Z0-9]{{4}}|{_TITLE}\.? \p{{Lu}}"


def _kind(mention: Column) -> Column:
    whole = [(k, mention.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items()]
    return reduce(lambda done, x: F.when(x[1], F.lit(x[0])).otherwise(done), reversed(whole), F.lit("card"))


def _canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    plain = F.regexp_replace(F.upper(mention), r"[^\p{L}\p{N}]", "")
    named = F.lower(F.regexp_replace(mention, rf"^{_TITLE}\.? ", ""))
    gender = F.when(mention.rlike(rf"^(?:{'|'.join(FEMALE)})\.? "), F.lit("f")).otherwise(F.lit("m"))
    return (
        F.when(kind == "email", F.lower(mention)).when(kind == "ip", mention).when(kind == "person", F.concat(gender, F.lit(":"), named)).otherwise(plain)
    )


def _stream(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """64 pseudo-random bytes, in hex: HMAC-SHA-512 of the entity and attempt."""
    secret = key.encode()
    secret = (hashlib.sha512(secret).digest() if len(secret) > 128 else secret).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\u0001", kind, canonical, attempt.cast("string")).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def _number(stream: Column, k: Column, below: Column | int) -> Column:
    """The k-th 16-bit word of the stream, below a bound."""
    return F.conv(F.substr(stream, 4 * k + 1, F.lit(4)), 16, 10).cast("int") % below


def _byte(stream: Column, k: Column) -> Column:
    return F.conv(F.substr(stream, (k % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _reshape(text: Column, stream: Column, fixed: Column) -> Column:
    """Every letter and digit after the first `fixed` of them replaced within its
    script and case; other characters stay."""

    def at(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(text, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        drawn = c
        for letters, accepted in zip(ALPHABETS, _LETTERS, strict=True):
            new = F.substr(F.lit(letters), _byte(stream, nth) % len(letters) + 1, F.lit(1))
            drawn = F.when(F.lower(c).rlike(accepted), F.when(c == F.lower(c), new).otherwise(F.upper(new))).otherwise(drawn)
        return F.when((nth <= fixed) | ~c.rlike(r"[\p{L}\p{N}]"), c).otherwise(drawn)

    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), at), ""))


def _digit(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1)).cast("int")


def _luhn(body: Column) -> Column:
    """The digit that a card number ends with."""
    n = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = _digit(body, i)
        return total + F.when((n - i) % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return ((10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10).cast("string")


def _iban_check(country: Column, account: Column) -> Column:
    """The two digits after an account's country."""
    whole = F.concat(account, country, F.lit("00"))

    def add(rest: Column, i: Column) -> Column:
        c = F.substr(whole, i, F.lit(1))
        letter = F.ascii(c) - 55  # A is 10
        return F.when(c.rlike("[0-9]"), rest * 10 + c.cast("int")).otherwise(rest * 100 + letter) % 97

    rest = F.aggregate(F.sequence(F.lit(1), F.length(whole)), F.lit(0), add)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _person(canonical: Column, stream: Column, attempt: Column) -> Column:
    """A name of the same gender, script and number of words: a family name, after
    a given one or tied to another if there are two."""
    name = F.substring(canonical, 3, 1 << 20)

    def words(lists: list[str]) -> Column:
        latin, cyrillic, greek = (F.split(F.lit(x), " ") for x in lists)  # literals, once they are folded
        return F.when(name.rlike("[а-яё]"), cyrillic).when(name.rlike("[α-ωά-ώ]"), greek).otherwise(latin)

    def of(table: dict, k: int) -> Column:
        chosen = F.when(canonical.startswith("f:"), words(table["f"])).otherwise(words(table["m"]))
        return F.element_at(chosen, _number(stream, F.lit(k), F.size(chosen)) + 1)

    syllables = words(SYLLABLES)
    more = F.transform(F.sequence(F.lit(4), 3 + F.least(attempt, F.lit(8))), lambda k: F.element_at(syllables, _number(stream, k, F.size(syllables)) + 1))
    family = F.concat(of(FAMILY, 0), F.when(attempt > 0, F.array_join(more, "")).otherwise(""))
    before = F.when(name.contains(" "), F.concat(of(GIVEN, 1), F.lit(" "))).when(name.contains("-"), F.concat(of(FAMILY, 2), F.lit("-"))).otherwise("")
    return F.concat(F.substring(canonical, 1, 2), before, family)


def _targets(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canonical, attempt) with their surrogates as `target`: in
    canonical form, but for a name's capitals."""
    kind, canonical, attempt, stream, reshaped = (F.col(c) for c in ("kind", "canonical", "attempt", "stream", "reshaped"))
    n = F.length(canonical)
    zero = canonical.startswith("0")
    kept = F.greatest(n - 10, zero.cast("int"))  # of a phone number
    last = F.regexp_extract(canonical, r"[^.]+$", 0)  # a mail address keeps its top-level domain
    base = F.when(kind == "email", F.substr(canonical, F.lit(1), n - F.length(last))).when(~kind.isin("ip", "person", "ssn"), canonical).otherwise("")
    fixed = F.when(kind == "card", 1).when(kind == "iban", 4).when(kind == "phone", kept).otherwise(0)
    drawn = entities.withColumn("stream", _stream(key, kind, canonical, attempt)).withColumn("reshaped", _reshape(base, stream, fixed))
    ip = F.concat_ws(".", *[(_byte(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)])
    card, account, country = F.substr(reshaped, F.lit(1), n - 1), F.substr(reshaped, F.lit(5), n), F.substring(canonical, 1, 2)
    security = F.concat(*[F.lpad((_number(stream, F.lit(k), most) + 1).cast("string"), width, "0") for k, most, width in ((0, 665, 3), (1, 99, 2), (2, 9999, 4))])
    first = F.when(zero, F.substr(reshaped, kept + 1, F.lit(1))).otherwise((_byte(stream, kept + 1) % 8 + 2).cast("string"))
    made = (
        F.when(kind == "email", F.concat(reshaped, last))
        .when(kind == "ip", ip)
        .when(kind == "person", _person(canonical, stream, attempt))
        .when(kind == "iban", F.concat(country, _iban_check(country, account), account))
        .when(kind == "ssn", security)
        .when(kind == "phone", F.concat(F.substr(reshaped, F.lit(1), kept), first, F.substr(reshaped, kept + 2, n)))
        .otherwise(F.concat(card, _luhn(card)))
    )
    longer = F.translate(F.substr(stream, F.lit(65), 4 * (attempt - ROOM)), "abcdef", "123456")
    grown = F.when(kind == "email", F.concat(longer, F.col("made"))).when(kind == "ip", F.concat("made", F.lit("."), longer)).otherwise(F.concat("made", longer))
    drawn = drawn.withColumn("made", made)
    return drawn.withColumn("target", F.when(attempt > ROOM, grown).otherwise(F.col("made"))).drop("stream", "reshaped", "made")


def _dressed(kind: Column, mention: Column, target: Column) -> Column:
    """The surrogate in the format of a mention."""
    letter = r"[\p{L}\p{N}]"

    def at(i: Column) -> Column:
        c = F.substr(mention, i, F.lit(1))
        nth = F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        new = F.substr(target, F.when(kind == "email", i).otherwise(nth), F.lit(1))
        return F.when(~c.rlike(letter), c).when(c == F.lower(c), F.lower(new)).otherwise(F.upper(new))

    placed = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), at), "")
    used = F.length(F.regexp_replace(mention, r"[^\p{L}\p{N}]", ""))
    rest = F.substr(target, used + 1, F.length(target))
    title = F.regexp_extract(mention, rf"^({_TITLE}\.? )", 1)
    return (
        F.when(kind == "person", F.concat(title, F.substring(target, 3, 1 << 20)))
        .when((kind == "ip") | ((kind == "email") & (F.length(mention) != F.length(target))), target)
        .when(kind == "email", placed)
        .otherwise(F.concat(placed, rest))
    )


def draw(entities: DataFrame, key: str) -> DataFrame:
    """kind, canonical, target: for each distinct entity (kind, canonical) a
    surrogate that no other entity has and that is none itself. Ends when every
    entity has one, as from attempt ROOM on each has thousands of times the room
    of the one before; each round is written."""
    kind, canonical, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    same = lambda c: F.when(kind == "person", F.lower(c)).otherwise(F.col(c))
    real = entities.select("kind", canonical.alias("taken"))
    left = entities.select("kind", "canonical").withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    while True:
        drawn = materialise(_targets(left, key).withColumn("taken", same("target")), "pii-drawn")
        taken = real if done is None else real.unionByName(done.select("kind", "taken"))
        clash = taken.join(drawn.select("kind", "taken"), ["kind", "taken"], "left_semi").distinct().withColumn("clash", F.lit(True))
        first = drawn.groupBy("kind", "taken").agg(F.min("canonical").alias("winner"))
        judged = drawn.join(first, ["kind", "taken"]).join(clash, ["kind", "taken"], "left")
        judged = materialise(judged.withColumn("settled", F.col("clash").isNull() & (canonical == F.col("winner"))).drop("winner", "clash"), "pii-judged")
        settled = judged.where("settled").drop("settled")
        done = settled if done is None else done.unionByName(settled)
        left = judged.where("not settled").select("kind", "canonical", (attempt + 1).alias("attempt"))
        if left.isEmpty():
            return done.select("kind", "canonical", "target")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities and a count for each kind, for
    every row of docs. key: the secret of the surrogates, at least 8 characters.

    docs needs doc_id and text; other columns are ignored. A null text comes out
    as the empty text, as an empty one does. Rows without an entity come out with
    their text unchanged, however long it is; a long text is searched as a whole.
    Repeated rows come as often as they are there, with equal surrogates. Of
    entities that drew the same surrogate the first by canonical form keeps it.
    An empty table gives an empty result.
    """
    if len(key) < 8:
        raise ValueError("a key of at least 8 characters is needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    mentions = F.when(F.col("text").rlike(_HINT), F.regexp_extract_all("text", F.lit(f"({_ANY})"), 1))
    hit = F.coalesce(F.size("mentions") > 0, F.lit(False))
    searched = texts.withColumn("mentions", mentions).select(
        "doc_id",
        F.when(~hit, F.col("text")).alias("text"),
        F.when(hit, F.col("mentions")).alias("mentions"),
        F.when(hit, F.split("text", _ANY, -1)).alias("gaps"),
        F.monotonically_increasing_id().alias("rid"),
        F.spark_partition_id().alias("src"),
    )
    searched = materialise(searched, "pii-searched")
    clean, hits = searched.where("mentions IS NULL"), searched.where("mentions IS NOT NULL")
    kind = _kind(F.col("mention"))
    found = (
        hits.select("rid", "src", F.posexplode("mentions").alias("nth", "mention"))
        .withColumn("kind", kind)
        .withColumn("canonical", _canonical(F.col("kind"), F.col("mention")))
    )
    found = materialise(found, "pii-mentions")
    drawn = draw(found.select("kind", "canonical").distinct(), key)
    # A target for each (entity, input partition) first: the mentions of an
    # entity that is everywhere stay spread over the partitions they came from.
    local = found.select("kind", "canonical", "src").distinct().join(drawn, ["kind", "canonical"])
    replaced = (
        found.join(local, ["kind", "canonical", "src"])
        .withColumn("surrogate", _dressed(F.col("kind"), F.col("mention"), F.col("target")))
        .groupBy("rid")
        .agg(
            F.sort_array(F.collect_list(F.struct("nth", "surrogate"))).alias("new"),
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        )
    )
    counts = [f"n_{k}" for k in KINDS]
    text = F.concat(
        F.array_join(F.transform("new", lambda x: F.concat(F.element_at("gaps", x["nth"] + 1), x["surrogate"])), ""),
        F.element_at("gaps", -1),
    )
    out = hits.select("doc_id", "gaps", "rid").join(replaced, "rid")
    return out.select("doc_id", text.alias("text"), F.size("new").cast("long").alias("n_entities"), *counts).unionByName(
        clean.select("doc_id", "text", *[F.lit(0).cast("long").alias(c) for c in ["n_entities", *counts]])
    )
