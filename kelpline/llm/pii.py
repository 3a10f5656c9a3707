"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by patterns. Each distinct entity of the corpus gets one surrogate, drawn from a
keyed hash: of the same type, gender, script and layout as the original. Draws are checked over the
whole corpus: of entities with equal surrogates all but one draw again, as does one whose surrogate
is a real entity, until none collides. So distinct entities stay distinct, and one entity reads the
same wherever and in whatever layout it stands.

Names are found after a title. Their given names and surnames are entities of their own, so Mr Smith
shares the surname of Mr John Smith, and words of a text that are name parts of it are replaced also
where they stand without a title.

Texts are rebuilt from what the pattern splits them into and the surrogates in between. Mentions meet
surrogates in a plain join by entity, which Spark splits where one entity has very many mentions.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.common import stage_table

# Patterns of entities, in order of preference.
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
#: A capitalised word of a name, with hyphens and apostrophes but no genitive.
WORD = "\\p{Lu}(?=\\p{L}|['’]\\p{L})\\p{L}*+(?:['’-](?!s(?!\\p{L}))\\p{L}++)*+"
TITLE = f"^(?:{MALE}|{FEMALE})\\.? "
PATTERNS = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\\.){1,126}[A-Za-z]{2,63}",
    "iban": "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": "(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": f"(?<![0-9.])(?:{OCTET}\\.){{3}}{OCTET}(?![0-9]|\\.[0-9])",
    "phone": "(?<![0-9+])(?:\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4})(?![0-9])",
    "name": f"(?<![\\p{{L}}])(?:{MALE}|{FEMALE})\\.? {WORD}(?: {WORD}){{0,3}}(?![\\p{{L}}])",
}
ANY = "|".join(PATTERNS.values())
#: What a text must hold for any pattern to match.
HINT = f"[0-9@]|{MALE}|{FEMALE}"
# The scripts that have capital letters, given names by gender and script, and syllables of surnames.
SCRIPTS = {"cyrillic": "[\\u0400-\\u04FF]", "greek": "[\\u0370-\\u03FF\\u1F00-\\u1FFF]", "armenian": "[\\u0530-\\u058F]"}
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Robert Simon Thomas Viktor".split(),
    ("f", "latin"): "Ada Berta Clara Diana Emma Flora Greta Helena Ida Julia Klara Lena Maria Nina Olga Paula Rosa Sara Tina Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Клара Лидия Мария Нина".split(),
    ("m", "greek"): "Ανδρέας Γιάννης Δημήτρης Θωμάς Κώστας Μάρκος Νίκος Παύλος Πέτρος Στέφανος".split(),
    ("f", "greek"): "Άννα Αγγελική Δήμητρα Ειρήνη Ελένη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("m", "armenian"): "Արամ Դավիթ Տիգրան Հայկ Վահան".split(),
    ("f", "armenian"): "Անի Մարիամ Նարե Լուսինե Սոնա".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са та".split(),
    "greek": "βα βε γα γο δα δε δο θα κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε το".split(),
    "armenian": "բա բե գա գո դա դե կա կե կո լա լե լո մա մե մո նա նե նո պա պե ռա ռո սա սե տա տե վա վե".split(),
}
ROUNDS = 24


def kind_of(mention: Column) -> Column:
    return F.coalesce(*(F.when(mention.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def canonical(kind: Column, mention: Column) -> Column:
    """What is equal for all layouts of an entity that isn't a name: digits of numbers, lower-cased mail."""
    phone = F.when(mention.startswith("+"), digits(mention)).otherwise(F.concat(F.lit("1"), digits(mention)))
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind == "phone", phone)
        .when(kind == "ip", mention)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(digits(mention))
    )


def _draw(seed: Column, place, among: int) -> Column:
    """A number below ``among`` for a place of the stream that ``seed`` starts."""
    return F.pmod(F.xxhash64(seed, place if isinstance(place, Column) else F.lit(place)), F.lit(among)).cast("int")


def _digit(seed: Column, place) -> Column:
    return _draw(seed, place, 10).cast("string")


def _per_char(text: Column, made) -> Column:
    return F.array_join(F.transform(F.split(text, ""), made), "")


def luhn(number: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.reverse(F.filter(F.split(number, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda s, d: s + d), F.lit(10))


def iban_rest(account: Column) -> Column:
    """An IBAN's number modulo 97, of its letters and digits without spaces."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(100)) + value(c), F.lit(97)))


def name_parts(kind: Column, mention: Column) -> Column:
    """The entities of a mention: (part, kind, entity, word); of a name each given name, with its gender, and the surname."""
    gender = F.when(mention.rlike(f"^(?:{MALE})\\b"), F.lit("m")).otherwise(F.lit("f"))
    words = F.split(F.regexp_replace(mention, TITLE, ""), " ")

    def part(w: Column, i: Column) -> Column:
        last = i == F.size(words) - 1
        return F.struct(i.alias("part"), F.when(last, F.lit("family")).otherwise(F.lit("given")).alias("kind"), F.when(last, F.lower(w)).otherwise(F.concat(gender, F.lit(":"), F.lower(w))).alias("entity"), w.alias("word"))

    whole = F.struct(F.lit(0).alias("part"), kind.alias("kind"), canonical(kind, mention).alias("entity"), mention.alias("word"))
    return F.when(kind == "name", F.transform(words, part)).otherwise(F.array(whole))


def surrogate(kind: Column, entity: Column, at: Column, attempt: int = 0) -> Column:
    """A draw for an entity in canonical form, in canonical form too, from the stream of the seed ``at``.

    There are few given names; from the second ``attempt`` on they are drawn with a second part.
    Surnames are a syllable longer with each attempt, so their space grows some thirtyfold and can't run
    out; addresses take in more reserved ranges from the fifth on.
    """

    def letter(base: int):
        return lambda i: F.char(F.lit(base) + _draw(at, i, 26))

    local = _per_char(F.substring_index(entity, "@", 1), lambda c, i: F.when(c.rlike("[0-9]"), _digit(at, i)).when(c.rlike("[a-z]"), letter(97)(i)).otherwise(c))
    domain = F.concat(*(letter(97)(F.lit(1000 + i)) for i in range(8)), F.lit(".example"))
    numbers = lambda text, held: _per_char(text, lambda c, i: F.when(i < held, c).when(c.rlike("[0-9]"), _digit(at, i)).when(c.rlike("[A-Z]"), letter(65)(i)).otherwise(c))
    card = numbers(entity, 1)
    # The last digit keeps the original's Luhn sum, so valid numbers stay valid.
    card_body = F.concat(F.substring(card, 1, F.length(card) - 1), F.lit("0"))
    card = F.concat(F.substring(card, 1, F.length(card) - 1), F.pmod(luhn(entity) - luhn(card_body), F.lit(10)).cast("string"))
    body = F.substring(numbers(entity, 4), 5, 100)
    rest = F.pmod(F.lit(98) - iban_rest(F.concat(F.substring(entity, 1, 2), F.lit("00"), body)), F.lit(97))
    iban = F.concat(F.substring(entity, 1, 2), F.lpad(F.when(rest < 2, rest + 97).otherwise(rest).cast("string"), 2, "0"), body)
    pick = lambda words, place: F.array(*map(F.lit, words))[_draw(at, place, len(words))]
    ssn = F.concat(F.lit("9"), *(_digit(at, i) for i in range(8)))
    ip = F.concat_ws(".", (240 + _draw(at, 0, 16) if attempt < 4 else pick([0, 10, 127, *range(224, 256)], 0)).cast("string"), *(_draw(at, i, 256).cast("string") for i in (1, 2, 3)))
    phone = numbers(entity, F.greatest(F.length(entity) - 10, F.lit(1)))
    gender = F.substring(entity, 1, 1)
    by_script = lambda made: reduce(lambda other, s: F.when(entity.rlike(SCRIPTS[s]), made(s)).otherwise(other), SCRIPTS, made("latin"))
    given = by_script(lambda s: F.when(gender == "m", pick(GIVEN["m", s], 0)).otherwise(pick(GIVEN["f", s], 0)))
    surname = by_script(lambda s: F.initcap(F.concat(*(pick(SYLLABLES[s], 1 + i) for i in range(4 + attempt)))))
    name = F.concat(gender, F.lit(":"), F.lower(F.when(F.instr(entity, " ") > 0, F.concat_ws(" ", given, surname)).otherwise(surname)))
    first = given if attempt == 0 else F.concat_ws("-", given, surname)
    made = F.when(kind == "given", F.concat(gender, F.lit(":"), F.lower(first))).when(kind == "family", F.lower(surname)).when(kind == "email", F.concat_ws("@", local, domain)).when(kind == "name", name).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "ssn", ssn).otherwise(card)
    return made


def rendered(kind: Column, mention: Column, made: Column) -> Column:
    """The surrogate in the layout of the mention: its separators, its case, its title."""
    n = F.length(digits(mention))
    right = F.substring(made, F.length(made) - n + 1, F.lit(100))
    place = lambda i: F.length(digits(F.substring(mention, F.lit(1), i + 1)))
    numbers = _per_char(mention, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(right, place(i), F.lit(1))).otherwise(c))
    compact = lambda i: F.length(F.regexp_replace(F.substring(mention, F.lit(1), i + 1), " ", ""))
    account = _per_char(mention, lambda c, i: F.when(c == " ", c).otherwise(F.substring(made, compact(i), F.lit(1))))
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(made)).otherwise(made)
    shown = F.array_join(F.transform(F.split(F.regexp_replace(made, "^[mf]:", ""), "-"), F.initcap), "-")
    shown = F.when(mention == F.upper(mention), F.upper(shown)).otherwise(shown)
    return F.when(kind == "email", cased).when(kind.isin("given", "family"), shown).when(kind == "ip", made).when(kind == "iban", account).otherwise(numbers)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, entity; distinct) with ``made``, no two alike within a kind and none a real entity.

    Each round the entities without a surrogate draw; a draw is kept if it is no real entity, no
    kept surrogate, and the first by entity among equal draws. Raises RuntimeError if some are left
    after ROUNDS rounds, which means that a layout of numbers has too few values for its entities; names
    can't run out.
    """
    # A local row, because the plan's text, which logs keep, would hold a literal.
    secret = entities.sparkSession.createDataFrame(pa.table({"_key": [key]}))
    entities = stage_table(entities, "entities")
    real = entities.select("kind", F.col("entity").alias("made"))
    open_, kept = entities, None
    for attempt in range(ROUNDS):
        inner = F.sha2(F.concat_ws("\x1f", "_key", "kind", "entity", F.lit(str(attempt))), 256)
        seeded = open_.crossJoin(F.broadcast(secret)).withColumn("_seed", F.sha2(F.concat("_key", inner), 256))
        drawn = seeded.select("kind", "entity", surrogate(F.col("kind"), F.col("entity"), F.col("_seed"), attempt).alias("made"))
        same = Window.partitionBy("kind", "made").orderBy("entity")
        fresh = drawn.withColumn("_n", F.row_number().over(same)).filter("_n = 1").drop("_n").join(real, ["kind", "made"], "left_anti")
        if kept is not None:
            fresh = fresh.join(kept.select("kind", "made"), ["kind", "made"], "left_anti")
        fresh = stage_table(fresh.select("kind", "entity", "made"), "drawn")
        kept = fresh if kept is None else kept.unionByName(fresh)
        open_ = stage_table(open_.join(fresh.select("kind", "entity"), ["kind", "entity"], "left_anti"), "open")
        if open_.isEmpty():
            return kept
    raise RuntimeError("a layout has too few surrogates for its entities")


def replaced(docs: DataFrame, secret: str, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text_col``, and ``entities``, an array of (kind, surrogate) in text order.

    Whoever knows ``secret`` can recompute the surrogate of an entity that they guess, so it has no
    default and mustn't be empty (ValueError).

    Null and empty texts, and texts without entities, stay as they are and have an empty array. Texts of
    any length are read whole.
    Words without a title that are parts of a name found in the same text are replaced, the surname
    first if a word is both, and aren't in ``entities``. Rows with equal key and text come out alike. A column ``entities`` of ``docs`` is replaced. The
    same ``secret`` gives the same surrogates, but for draws that collide with other entities.
    """
    if not secret:
        raise ValueError("surrogates need a secret")
    plain = docs.drop("entities")
    text = F.col(text_col)
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    mentions = plain.select(F.col(key).alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(found).alias("at", "mention"))
    mentions = mentions.distinct().withColumn("kind", kind_of(F.col("mention")))
    at = ["doc", "mark", "at", "mention", "whole"]
    parts_of = mentions.withColumnRenamed("kind", "whole").select(*at, F.explode(name_parts(F.col("whole"), F.col("mention"))).alias("p")).select(*at, "p.*")
    mentions = stage_table(parts_of, "mentions")
    made = surrogates(mentions.select("kind", "entity").distinct(), secret)
    shown = rendered(F.col("kind"), F.col("word"), F.col("made")).alias("shown")
    named = stage_table(mentions.join(made, ["kind", "entity"]).select(*at, "part", "kind", "word", shown), "named")
    names = named.filter("whole = 'name'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "shown"))), lambda x: x["shown"]), " ")
    titled = names.groupBy(*at).agg(joined.alias("_joined")).withColumn("shown", F.concat(F.regexp_extract("mention", TITLE, 0), "_joined"))
    columns = ["doc", "mark", F.struct("at", F.col("whole").alias("kind"), F.col("shown").alias("surrogate")).alias("one")]
    single = named.filter("whole <> 'name'").select(*columns).unionByName(titled.select(*columns))
    lists = single.groupBy("doc", "mark").agg(F.array_sort(F.collect_list("one")).alias("__list"))
    words = names.groupBy("doc", "mark", "word").agg(F.min(F.struct("kind", "shown"))["shown"].alias("shown"))
    words = words.groupBy(F.col("doc").alias("_d"), F.col("mark").alias("_m")).agg(F.map_from_entries(F.collect_list(F.struct("word", "shown"))).alias("__words"))
    lists = lists.join(words, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")), "left").drop("_d", "_m")
    lists = stage_table(lists.withColumnsRenamed({"doc": "__doc", "mark": "__mark"}), "lists")
    met = plain.join(lists.hint("shuffle_hash"), plain[key].eqNullSafe(lists["__doc"]) & (F.xxhash64(plain[text_col]) == lists["__mark"]), "left")
    alone = f"(?<![\\p{{L}}]){WORD}"
    known = lambda s: F.concat(F.transform(F.regexp_extract_all(s, F.lit(alone), F.lit(0)), lambda w: F.coalesce(F.try_element_at("__words", w), w)), F.array(F.lit("")))
    untitled = lambda s: F.array_join(F.zip_with(F.split(s, alone, -1), known(s), lambda a, b: F.concat(a, b)), "")
    parts = F.split(text, ANY, -1)
    parts = F.when(F.col("__words").isNull(), parts).otherwise(F.transform(parts, untitled))
    filled = F.concat(F.transform(F.col("__list"), lambda x: x["surrogate"]), F.array(F.lit("")))
    rebuilt = F.array_join(F.zip_with(parts, filled, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = F.when(F.col("__list").isNull(), text).otherwise(rebuilt)
    entities = F.transform(F.coalesce("__list", F.array().cast("array<struct<at:int,kind:string,surrogate:string>>")), lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate")))
    return met.select(*(out.alias(c) if c == text_col else plain[f"`{c}`"] for c in plain.columns), entities.alias("entities"))
