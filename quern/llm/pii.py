"""PII: detected entities receive keyed surrogates of their own kind.

One pattern finds e-mail addresses, IBANs, phone numbers, social security numbers, card numbers, IPv4
addresses, secret tokens, and names after a form of address or after a common given name. Entities are made of
parts: an e-mail address of a local part and a domain, a name of a family name and perhaps a given name, others of
one part. A part has a canonical form that all its spellings share (letters of one case, digits without
separators, no form of address), and its surrogate is drawn from a keyed hash of that. So `Mr. Adam Meyer` and
`Mr Meyer` share a family name afterwards, `+49 30 123456` and `+49-30-123456` a number, and both in every
document (coreference).

A surrogate keeps the format: digits become digits, letters letters of the same script and case, separators stay;
e-mail addresses keep their top-level domain, international numbers their first digit, IBANs their country; IPv4
addresses stay valid; card numbers that pass the Luhn check give surrogates that do; given names come from a list
for the gender that the form of address or the given name tells (other scripts than Latin keep their script).

Collision check: over all different parts, surrogates must differ from each other and from every real one. Those
that fail draw again (with the next attempt number) until none does; they are few and are carried by a join of
their own, while all others are computed where the text is read. Where ATTEMPTS draws don't do (a short format has
fewer surrogates than parts), addresses, names and phone numbers get WIDER more characters; if that fails too, an
error is raised and nothing is written.

All repeats of groups in the patterns are bounded, so that texts of megabytes that almost match don't exhaust the
regex engine's stack. Only DataFrame functions are used. Defined cases: null text stays null and has no entities;
an empty text stays empty; repeated rows and texts are treated alike; names without a form of address or a given
name of GIVEN are not found; an empty table gives none; other columns of docs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import shuffle_partitions, small_side, stage, table

#: What secrets without a digit begin with.
TOKENS = ["AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]
#: Forms of address.
ADDRESSES = ["Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
#: Common given names, found before a family name and drawn as surrogates.
GIVEN_MALE = ["Adam", "Alexander", "Andreas", "Anthony", "Ben", "Carl", "Carlos", "Christopher", "Daniel", "David", "Emil", "Felix", "Georg", "George", "Hans", "Hugo", "Ivan", "James", "Javier", "John", "Jonas", "Joseph", "Karl", "Leo", "Louis", "Luis", "Martin", "Michael", "Miguel", "Nils", "Oscar", "Paul", "Peter", "Pierre", "Robert", "Simon", "Stefan", "Thomas", "Victor", "William"]
GIVEN_FEMALE = ["Alice", "Ana", "Andrea", "Anna", "Barbara", "Berta", "Carmen", "Clara", "Diana", "Elizabeth", "Emma", "Frida", "Greta", "Helen", "Ida", "Isabel", "Jane", "Jennifer", "Julia", "Karla", "Laura", "Linda", "Lucia", "Maria", "Marie", "Mary", "Nora", "Olga", "Patricia", "Paula", "Rosa", "Sabine", "Sara", "Sarah", "Sofia", "Sophie", "Susan", "Tina", "Ursula", "Vera"]
GIVEN = GIVEN_MALE + GIVEN_FEMALE
#: (type, pattern), tried in this order at each place of a text.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,32}[A-Za-z]{2,63}(?![A-Za-z0-9])"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"),
    ("ip", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"),
    ("secret", r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{20,}|(?=[0-9a-f]*[0-9])[0-9a-f]{32,128})(?![\p{L}\p{N}])"),
    ("name", rf"\b(?:{'|'.join(ADDRESSES)})\b\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?|\b(?:{'|'.join(GIVEN)}) \p{{Lu}}[\p{{Ll}}'’-]+\b"),
]
ANY = "|".join(p for _, p in PATTERNS)
#: Draws in a part's own length, and characters that a surrogate gets beyond it afterwards.
ATTEMPTS, WIDER = 20, 8
DEFAULT_KEY = "quern"
#: Texts with redrawn parts whose maps are broadcast at most: maps hold a few parts each.
MAPS = 100_000
#: (upper and lower letters that stand in for one another), by script.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "àáâãäåèéêëìíîïòóôõöùúûüñç", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"]

#: What stands in for other letters and digits, by the first pattern that matches; none stays as it is.
OTHERS = [
    (r"[\p{IsLatin}&&\p{Lu}]", "ĀĂĆČĎĐĒĘĚĞĢĪĶŁĻŃŇŌŐŘŚŠŤŪŮŹŽ"),
    (r"\p{IsLatin}", "āăćčďđēęěğģīķłļńňōőřśšťūůźž"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", ALPHABETS[2].upper()),
    (r"\p{IsCyrillic}", ALPHABETS[2]),
    (r"[\p{IsGreek}&&\p{Lu}]", ALPHABETS[3].upper()),
    (r"\p{IsGreek}", ALPHABETS[3]),
    (r"\p{IsHan}", "一丁七三上下中主久乙九了二人今仁他以任休何作使來供保信修元先光全公六"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモ"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsDevanagari}", "अआइईउऊएऐओऔकखगघचछजझटठडढतथदधनपफबभमयरलवशसह"),
    (r"\p{Lu}", ALPHABETS[0].upper()),
    (r"\p{L}", ALPHABETS[0]),
    (r"\p{N}", "0123456789"),
]


def _draw(key: Column, what: Column, attempt: Column, i: Column) -> Column:
    """A keyed number from 0 to 2**32 - 1 for place i."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", key, what, attempt.cast("string"), i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")


def _like(text: Column, key: Column, what: Column, attempt: Column) -> Column:
    """text with every letter and digit redrawn among its own kind."""

    def one(c: Column, i: Column) -> Column:
        # the draw is written once, as plans grow with every copy of it; no pool, no draw
        pool = F.when(c.between("0", "9"), "0123456789")
        for alphabet in ALPHABETS:
            pool = pool.when(F.lit(alphabet).contains(c), alphabet).when(F.lit(alphabet.upper()).contains(c), alphabet.upper())
        other = F.when(~c.rlike(r"[\p{L}\p{N}]"), None)
        for pattern, letters in OTHERS:
            other = other.when(c.rlike(pattern), letters)
        pool = pool.otherwise(other)
        return F.coalesce(F.substring(pool, (F.pmod(_draw(key, what, attempt, i), F.length(pool)) + 1).cast("int"), F.lit(1)), c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one counted once."""
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def add(acc: Column, c: Column) -> Column:
        v = c.cast("int") * (1 + F.pmod(acc["i"], F.lit(2)))
        return F.struct((acc["t"] + F.when(v > 9, v - 9).otherwise(v)).alias("t"), (acc["i"] + 1).alias("i"))

    return F.aggregate(backwards, F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")), add, lambda acc: acc["t"])


def type_of(entity: Column) -> Column:
    """The first type whose pattern matches the whole entity."""
    out = F.lit("name")
    for name, pattern in reversed(PATTERNS):
        # look-behinds hold at an entity's start, look-aheads at its end
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _name(entity: Column) -> tuple[Column, Column, Column]:
    """(what stays before the name, given name or null, family name)."""
    words = F.split(entity, " ")
    titled = F.regexp_replace(words[0], r"\.$", "").isin(ADDRESSES)
    given = F.when(titled & (F.size(words) > 2), F.get(words, F.lit(1))).when(~titled, words[0])
    return F.when(titled, F.concat(words[0], F.lit(" "))).otherwise(""), given, F.element_at(words, -1)


def _gender(entity: Column) -> Column:
    """m or f, by the form of address, else by the given name."""
    word = F.regexp_replace(F.substring_index(entity, " ", 1), r"\.$", "")
    return F.when(word.isin(MALE + GIVEN_MALE), "m").otherwise("f")


def parts_of(entity: Column, kind: Column) -> Column:
    """The entity's parts, (kind, canon): what spellings that mean the same share. The part that makes the whole
    distinct comes first; a local part names its domain and a given name its gender and family."""
    part = lambda kind, canon: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), canon.alias("canon"))
    _, given, family = _name(entity)
    email = F.array(part("local", F.lower(entity)), part("domain", F.lower(F.substring_index(entity, "@", -1))))
    named = F.when(given.isNull(), F.array(part("family", F.lower(family)))).otherwise(F.array(part("family", F.lower(family)), part("given", F.concat_ws("|", _gender(entity), F.lower(given), F.lower(family)))))
    plain = F.when(kind == "phone", F.regexp_replace(entity, "[^0-9+]", "")).when(kind.isin("card", "iban", "ssn"), F.regexp_replace(entity, "[ -]", "")).otherwise(entity)
    return F.when(kind == "email", email).when(kind == "name", named).otherwise(F.array(part(kind, plain)))


def drawn(kind: Column, canon: Column, key: Column, attempt: Column) -> Column:
    """The surrogate of a part, in canonical form."""
    what = F.concat_ws("\x1e", kind, canon)
    before = F.when((kind == "phone") & canon.startswith("+"), F.substring(canon, 1, 2)).when(kind == "iban", F.substring(canon, 1, 2)).when(kind == "secret", F.regexp_extract(canon, r"^(AKIA|gh[pousr]_|sk-)?", 1)).otherwise("")
    given = F.element_at(F.split(canon, r"\|"), 2)
    body = F.when(kind == "local", F.substring_index(canon, "@", 1)).when(kind == "domain", F.regexp_replace(canon, r"\.[^.]+$", "")).when(kind == "given", given).otherwise(F.substring(canon, F.length(before) + 1, F.length(canon)))
    wider = F.when(attempt < ATTEMPTS, "").when(kind == "phone", "0" * WIDER).when(kind.isin("local", "domain", "family", "given"), "a" * WIDER).otherwise("")
    like = _like(F.concat(body, wider), key, what, attempt)
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(_draw(key, what, attempt, F.lit(-1)), F.lit(len(names))) + 1).cast("int"))
    first = F.when((attempt >= ATTEMPTS) | ~given.rlike(r"^[a-zà-ÿ'’-]+$"), like).when(canon.startswith("m"), pick(GIVEN_MALE)).otherwise(pick(GIVEN_FEMALE))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.pmod(_draw(key, what, attempt, i), F.lit(256)).cast("string")), ".")
    short = F.substring(like, F.lit(1), F.length(like) - 1)
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(short, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_sum(canon), F.lit(10)) == 0, F.concat(short, check)).otherwise(like)
    digest = F.substring(F.sha2(F.concat_ws("\x1f", key, what, attempt.cast("string")).cast("binary"), 512), F.lit(1), F.length(canon))
    out = F.when(kind == "given", first).when(kind == "domain", F.concat(like, F.lit("."), F.substring_index(canon, ".", -1)))
    out = out.when(kind == "ip", octets).when(kind == "card", card).when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), digest)
    return out.otherwise(F.concat(before, like))


def _cased(form: Column, new: Column) -> Column:
    """new, in canonical form, with the case of the form that it stands for, letter by letter."""
    letters = F.split(form, "")
    by_place = F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.get(letters, i) != F.lower(F.get(letters, i)), F.upper(c)).otherwise(c)), "")
    return F.when(form == F.lower(form), new).when(form == F.upper(form), F.upper(new)).otherwise(by_place)


def _placed(form: Column, new: Column) -> Column:
    """new's digits and letters put where the form has its own; what is left follows."""

    def put(acc: Column, c: Column) -> Column:
        filled = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(acc["s"], F.when(filled, F.substring(new, acc["i"], F.lit(1))).otherwise(c)).alias("s"), (acc["i"] + filled.cast("int")).alias("i"))

    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), put, lambda acc: F.concat(acc["s"], F.substring(new, acc["i"], F.length(new))))


def shaped(entity: Column, kind: Column, new: Column) -> Column:
    """The entity's surrogate from its parts' (an array), in the entity's own format."""
    before, given, family = _name(entity)
    name = F.concat(before, F.coalesce(F.concat(F.when(F.get(new, F.lit(1)).rlike("^[A-Z]"), F.when(given == F.upper(given), F.upper(F.get(new, F.lit(1)))).otherwise(F.get(new, F.lit(1)))).otherwise(_cased(given, F.get(new, F.lit(1)))), F.lit(" ")), F.lit("")), _cased(family, new[0]))
    email = F.concat(_cased(F.substring_index(entity, "@", 1), new[0]), F.lit("@"), _cased(F.substring_index(entity, "@", -1), F.get(new, F.lit(1))))
    placed = _placed(entity, F.regexp_replace(new[0], r"^\+", ""))
    return F.when(kind == "email", email).when(kind == "name", name).when(kind.isin("phone", "card", "iban", "ssn"), placed).otherwise(new[0])


def surrogate(entity: Column, kind: Column, key: Column, attempt) -> Column:
    """attempt: a function of a part, (kind, canon), or a column for all parts."""
    of = attempt if callable(attempt) else lambda p: attempt
    new = F.transform(parts_of(entity, kind), lambda p: drawn(p["kind"], p["canon"], key, of(p)))
    return F.transform(F.array(new), lambda n: shaped(entity, kind, n))[0]


def found(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a hash of the text and entities, an array of them in order (empty where there is none)."""
    text = F.col("text")
    # texts without any of these have no entity
    hint = text.rlike("[0-9@]") | text.rlike(f"(?:{'|'.join(ADDRESSES + TOKENS)})") | text.rlike(rf"\b(?:{'|'.join(GIVEN)}) \p{{Lu}}")
    hit = F.when(hint, F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).withColumn("entities", F.coalesce(hit, F.array().cast("array<string>")))


def _identity(kind: Column, canon: Column) -> Column:
    """What surrogates of a kind must not share: of a given name, itself and the family."""
    return F.when(kind == "given", F.substring_index(canon, "|", -2)).otherwise(canon)


def redrawn(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the parts whose first surrogate won't do. parts: different ones (kind, canon).

    Of parts that share a surrogate the one that drew it first keeps it, of those the smallest, so a part that is
    settled stays so; a surrogate that is real goes.
    """
    k, tasks = F.lit(key), shuffle_partitions(parts.sparkSession)
    now = stage(parts.select("kind", "canon", F.lit(0).alias("attempt"), F.lit(0).alias("since")), "parts")
    new = drawn(F.col("kind"), F.col("canon"), k, F.col("attempt"))
    whole = F.when(F.col("kind") == "given", F.concat_ws("|", F.lower("new"), F.substring_index("canon", "|", -1))).when(F.col("kind") == "local", F.concat_ws("@", "new", F.substring_index("canon", "@", -1))).otherwise(F.col("new"))
    for turn in range(1, 2 * ATTEMPTS + 1):
        # few rows, but dear ones: not to be left to the one task that reads their small file
        fresh = stage(now.repartition(tasks, "canon").withColumn("new", new).withColumn("new", whole), "drawn")
        shared = fresh.groupBy("kind", "new").agg(F.min(F.struct("since", "canon")).alias("keeps"), F.count("*").alias("n")).where("n > 1")
        real = now.select("kind", _identity(F.col("kind"), F.col("canon")).alias("new")).distinct()
        taken = fresh.join(shared, ["kind", "new"]).where("canon <> keeps.canon").select("kind", "canon")
        taken = stage(taken.union(fresh.join(real, ["kind", "new"], "left_semi").select("kind", "canon")).distinct(), "taken")
        if taken.limit(1).count() == 0:
            break
        again = now.join(taken.withColumn("bad", F.lit(1)), ["kind", "canon"], "left")
        now = stage(again.select("kind", "canon", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt"), F.when(F.col("bad") == 1, turn).otherwise(F.col("since")).alias("since")), "parts")
    else:
        raise RuntimeError(f"surrogates still collide after {2 * ATTEMPTS} draws: {taken.count()} parts")
    return now.where("attempt > 0").drop("since")


def replaced(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds, surrogates): the text with surrogates, and what they are, in order."""
    all_of = found(docs)
    with_some = stage(all_of.where(F.size("entities") > 0).select("hash", F.array_distinct("entities").alias("entities")), "found")
    entities = stage(with_some.select(F.explode("entities").alias("entity")).distinct().withColumn("kind", type_of(F.col("entity"))), "entities")
    parts = entities.select("entity", F.explode(parts_of(F.col("entity"), F.col("kind"))).alias("p")).select("entity", "p.kind", "p.canon")
    odd = stage(redrawn(parts.select("kind", "canon").distinct(), key), "odd")
    # only texts that hold such a part get a map of their attempts; texts of one hash may share a map
    named = lambda kind, canon: F.concat_ws("\x1e", kind, canon)
    odd = parts.join(small_side(odd), ["kind", "canon"]).select("entity", named(F.col("kind"), F.col("canon")).alias("part"), "attempt")
    maps = with_some.select("hash", F.explode("entities").alias("entity")).join(small_side(stage(odd, "odd")), "entity")
    maps = maps.groupBy("hash").agg(F.map_from_entries(F.collect_set(F.struct("part", "attempt"))).alias("attempts"))
    maps = stage(maps.withColumnRenamed("hash", "_hash"), "attempts")
    rows = all_of.join(small_side(maps, MAPS), F.col("hash") == F.col("_hash"), "left")
    k = F.lit(key)

    def new(e: Column) -> Column:
        return surrogate(e, type_of(e), k, lambda p: F.coalesce(F.element_at(F.col("attempts"), named(p["kind"], p["canon"])), F.lit(0)))

    rows = rows.select("doc_id", "text", "entities", F.transform("entities", type_of).alias("kinds"), F.transform("entities", new).alias("surrogates"))
    between = F.split("text", ANY, -1)
    woven = F.array_join(F.zip_with(between, F.col("surrogates"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return rows.select("doc_id", F.when(F.size("entities") > 0, woven).otherwise(F.col("text")).alias("text"), F.size("entities").alias("n_entities"), "kinds", "surrogates")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents"))
