"""Surrogates for personal data, in DataFrame operations only.

One regular expression finds e-mail addresses, IPv4 addresses, payment cards (Luhn), phone
numbers, national ids and titled names; it passes over each text once and marks them. A long
run of digits is one match first; a second expression then finds the cards, phone numbers and
ids in it. In a text with titled names, untitled mentions of the same people are marked too:
whole names, family names and given names.

Every distinct entity gets a surrogate derived from a secret key, of the same type and format.
A person is the name without its title. Its surrogate is a given name of the gender that the
corpus' titles tell (neutral where they tell none or both) and the surrogate of its family
name, both in the name's script, so all mentions of a person or a family stay joined.
Surrogates are checked over the whole corpus: no two entities may share one, and none may be
an entity that occurs; losers are derived again with the next round number. From round WIDEN
on a form grows by a character a round, so there is room for any number of entities: a full
form is left, and no entity's own form is ever given to another.
"""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, documents, salted_lookup, text_of, written

#: The session setting that holds the secret key of the query.
KEY_SETTING = "riskloom.pii.key"
#: The round from which on a form that collides grows.
WIDEN = 8

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
# A run of 13 digits or more with single blanks or hyphens; it ends before a group that begins an e-mail or IP address.
_RUN = r"(?<![0-9])[0-9](?=(?:[ -]?[0-9]){12})[0-9 -]*(?:(?<= )|(?<=[0-9-])(?![0-9]|\.[0-9]|[A-Za-z0-9._%+-]*+@))"
# Groupings of cards, tried from every group of a run; a match of Luhn's sum by another grouping counts only where a run holds nothing else.
_GROUPED = [r"[3-6][0-9]{3}(?:[ -][0-9]{4}){3}", r"3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5}", r"3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4}", r"[3-6][0-9]{12,18}", r"[3-6][0-9]{3}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}"]
_CARD = r"(?<![0-9])[3-6](?:[ -]?[0-9]){12,18}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_PHONE = "|".join(
    (
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{2,4}(?![0-9])",
        r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)(?:[ .-]?[0-9]){5,11}(?![0-9])",
        r"\+[0-9](?:[ .-]?[0-9]){7,14}(?![0-9])",
        r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9])",
        r"(?<![0-9.-])[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9]|[.-][0-9])",
        r"(?<![0-9.-])(?<![0-9] )0[1-9](?: [0-9]{2}){4}(?![0-9]|[ .-][0-9])",
        r"(?<![0-9.-])(?<![0-9] )0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9]|[ .-][0-9])",
    )
)
# Titles and the gender they tell: f, m or n.
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "господин": "m", "госпожа": "f", "Dr": "n", "Prof": "n"}
_TITLE = "(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?"
_PART = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+)*+"
_NAME = rf"(?<![\p{{L}}]){_TITLE} {_PART}(?:-{_PART})*(?: {_PART}(?:-{_PART})*)?(?!\p{{L}})"
#: Each family of forms is tried only where its first character may stand.
_INITIALS = "".join(sorted({t[0] for t in TITLES}))
ENTITY = f"{_EMAIL}|(?=[0-9+(])(?:{_IP}|{_RUN}|{_PHONE}|{_SSN})|(?=[{_INITIALS}]){_NAME}"
_IN_RUN = f"{_SSN}|{_PHONE}"

# Given names by script and gender; family names are built from syllables of the script.
GIVEN = {
    "latin": {"m": "Adam Ben Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul".split(), "f": "Alice Berta Clara Diana Emma Flora Greta Helen Ida Julia Klara Laura Maria Nora Olga Paula".split(), "n": "Alex Robin Kim Sasha Jamie Noel Dominique Andrea Toni Luca Sam Jules Charlie Kay Micha Jona".split()},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Марк Никита Олег Павел Роман Степан".split(), "f": "Анна Белла Вера Галина Дарья Елена Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса Софья".split(), "n": "Саша Женя Валя Шура Слава Паша Тоня Миша Вася Лёня Гена Митя Костя Лёша Витя Гриша".split()},
}
SYLLABLES = {"latin": "ba ben dor fel gar hal jor kan len mar nor pel rin sol tan wel".split(), "cyrillic": "ба бен дор фел гар хал жор кан лен мар нор пел рин сол тан вел".split()}


def kind_of(match: Column) -> Column:
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(match.rlike(r"^\p{L}"), "name")
        .when(match.rlike(rf"^{_CARD}$"), F.when(_luhn(_digits(match)) % 10 == 0, "card"))
        .otherwise("phone")
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, doubling every second one from the right."""
    chars = F.reverse(F.split(digits, ""))
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, x: a + x)


def _parts(match: Column) -> Column:
    """The pieces of a match in order, as structs (text, hit): hits are entities, unless the
    kind of one is null; the other pieces stay as they are."""
    passes = lambda x: _luhn(_digits(x)) % 10 == 0
    all_of = lambda shape, group: F.regexp_extract_all(match, F.lit(shape), F.lit(group))
    cards = F.filter(F.concat(*[all_of(rf"(?<![0-9])(?=({shape})(?![0-9]))", 1) for shape in _GROUPED]), passes)
    others = F.filter(all_of(_CARD, 0), passes)
    either = lambda found: F.concat(F.lit("(?<![0-9])(?:"), F.array_join(found, "|"), F.lit(")(?![0-9])"))
    pattern = F.when(F.size(cards) > 0, F.concat(either(cards), F.lit("|" + _IN_RUN))).when(match.rlike(_IN_RUN), F.lit(_IN_RUN)).when(F.size(others) > 0, either(others)).otherwise("(?!)")
    piece = lambda hit: lambda x: F.struct(x.alias("text"), F.lit(hit).alias("hit"))
    hits = F.transform(F.regexp_extract_all(match, pattern, F.lit(0)), piece(True))
    rest = F.transform(F.split(match, pattern, -1), piece(False))
    inside = F.flatten(F.zip_with(rest, hits, lambda r, h: F.filter(F.array(r, h), lambda x: x.isNotNull())))
    return F.when(match.rlike(rf"^{_RUN}$"), inside).otherwise(F.array(F.struct(match.alias("text"), F.lit(True).alias("hit"))))


def gender_of(match: Column) -> Column:
    """What the title of a mention tells: f, m, or null."""
    title = F.regexp_replace(F.regexp_extract(match, rf"^({_TITLE}) ", 1), r"\.", "")
    out = F.lit(None).cast("string")
    for word, g in TITLES.items():
        out = F.when(title == word, g if g != "n" else None).otherwise(out)
    return out


def untitled(match: Column) -> Column:
    return F.regexp_replace(match, rf"^{_TITLE} ", "")


def canonical(kind: Column, match: Column) -> Column:
    """What makes two mentions the same entity: case, separators and titles do not count."""
    return (
        F.when(kind == "email", ascii_lower(match))
        .when(kind == "ip", match)
        .when(kind == "phone", F.concat(F.when(match.startswith("+"), "+").otherwise(""), _digits(match)))
        .when(kind.isin("name", "family"), untitled(match))
        .otherwise(_digits(match))
    )


def _pick(stream: Column, at: int, options: list[str]) -> Column:
    index = F.conv(F.substring(stream, at, 4), 16, 10).cast("int") % len(options)
    return F.element_at(F.array(*map(F.lit, options)), index + 1)


def derived(kind: Column, canon: Column, gender: Column, family: Column, round_: Column, key: str, widen: int = WIDEN) -> Column:
    """The canonical form of the surrogate of an entity, for a round. Names have more room in
    later rounds, all forms from round `widen` on: a digit, letter or group of digits a round."""
    more = F.greatest(F.lit(0), round_ - widen + 1)
    stream = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, round_.cast("string")), 256)
    digits = F.translate(stream, "abcdef", "314159")
    digits = F.concat(digits, F.translate(F.sha2(stream, 512), "abcdef", "271828"))
    refill = lambda first: F.concat(F.substr(canon, F.lit(1), first), F.substr(digits, F.lit(1), F.length(canon) - first + more))
    card = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(digits, F.lit(1), F.length(canon) - 2 + more))
    check = (10 - _luhn(F.concat(card, F.lit("0"))) % 10) % 10
    octet = lambda at: (F.conv(F.substring(stream, at, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    letters = F.translate(F.substr(F.concat(stream, F.sha2(stream, 256)), F.lit(1), F.least(F.length(local), F.lit(64))), "0123456789", "ghijklmnop")
    shaped = F.array_join(F.zip_with(F.split(local, ""), F.split(letters, ""), lambda a, b: F.when(a.rlike("[0-9]"), (F.ascii(b) % 10).cast("string")).when(a.rlike("[a-z]"), b).otherwise(a)), "")
    host = F.concat(F.lit("h"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 8), F.lit(".example"))
    spread = F.when(round_ > 2, F.translate(F.substr(F.concat(F.substring(stream, 33, 8), F.sha2(stream, 512)), F.lit(1), 8 + more), "0123456789abcdef", "aeiouaeiouaeioua")).otherwise("")
    script = lambda of: F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))

    def surname(script_: str) -> Column:
        return F.initcap(F.concat(*[_pick(stream, at, SYLLABLES[script_]) for at in (5, 9, 13, 17, 21)], spread))

    def person(script_: str) -> Column:
        by = lambda at: F.when(gender == "m", _pick(stream, at, GIVEN[script_]["m"])).when(gender == "f", _pick(stream, at, GIVEN[script_]["f"])).otherwise(_pick(stream, at, GIVEN[script_]["n"]))
        made = F.initcap(F.concat(*[_pick(stream, at, SYLLABLES[script_]) for at in (25, 29)], spread))
        return F.when(round_ < 2, by(1)).when(round_ < 4, F.concat(by(1), F.lit("-"), by(5))).otherwise(F.concat(by(1), F.lit("-"), made))

    return (
        F.when(kind == "email", F.concat(shaped, F.when(round_ > 2, F.substr(stream, F.lit(1), 6 + more)).otherwise(""), F.lit("@"), host))
        .when(kind == "ip", F.concat(F.concat_ws(".", octet(1), octet(5), octet(9), octet(13)), F.when(more > 0, F.concat(F.lit("."), F.substr(digits, F.lit(1), more))).otherwise("")))
        .when(kind == "card", F.concat(card, check.cast("string")))
        .when(kind == "phone", refill(F.when(canon.startswith("+"), F.lit(2)).otherwise(F.lit(0))))
        .when(kind == "family", script(surname))
        .when(kind == "name", F.concat_ws(" ", script(person), family))
        .otherwise(refill(F.lit(0)))
    )


def assigned(entities: DataFrame, key: str, widen: int = WIDEN) -> DataFrame:
    """entities(kind, canon, gender, family), distinct by kind and canon, to (kind, canon,
    surrogate) without collisions. Rounds go on until none is left."""
    form = lambda round_: derived(F.col("kind"), F.col("canon"), F.col("gender"), F.col("family"), round_, key, widen)
    columns = ["kind", "canon", "gender", "family"]
    settled = written(entities.select(*columns, F.lit(0).alias("round"), form(F.lit(0)).alias("surrogate")), "surrogates")
    while True:
        uses = settled.select("kind", F.col("surrogate").alias("form"), F.col("canon").alias("owner")).unionByName(settled.select("kind", F.col("canon").alias("form"), F.lit(None).cast("string").alias("owner")))
        held = uses.groupBy("kind", "form").agg(F.min("owner").alias("first"), F.count("owner").alias("n"), F.count(F.lit(1)).alias("all"))
        bad = written(held.where("n > 1 OR (n = 1 AND all > 1)").select("kind", F.col("form").alias("surrogate"), F.when(F.col("all") > F.col("n"), F.lit(None).cast("string")).otherwise(F.col("first")).alias("keeps")), "collisions")
        if bad.limit(1).count() == 0:
            return settled.select("kind", "canon", "surrogate")
        marked = settled.join(bad.withColumn("bad", F.lit(True)), ["kind", "surrogate"], "left")
        again = F.coalesce("bad", F.lit(False)) & ~F.col("canon").eqNullSafe(F.col("keeps"))
        settled = marked.select(*columns, F.when(again, F.col("round") + 1).otherwise(F.col("round")).alias("round"), F.when(again, form(F.col("round") + 1)).otherwise(F.col("surrogate")).alias("surrogate"))
        settled = written(settled, "surrogates")


def surrogates_of(entities: DataFrame, key: str) -> DataFrame:
    """entities(kind, canon, gender), distinct by kind and canon, to (kind, canon, surrogate).
    Family names are settled first; a whole name has its family name's surrogate in it."""
    family = F.substring_index("canon", " ", -1)
    people = entities.where("kind = 'name'").withColumn("surname", family)
    none = F.lit(None).cast("string")
    families = entities.where("kind = 'family'").select("canon").unionByName(people.select(F.col("surname").alias("canon"))).groupBy("canon").agg(F.count(F.lit(1)).alias("weight"))
    families = written(families, "families")
    named = assigned(families.select(F.lit("family").alias("kind"), "canon", none.alias("gender"), none.alias("family")), key)
    known = families.join(named.select("canon", F.col("surrogate").alias("family")), "canon").select(F.col("canon").alias("surname"), "family", "weight")
    people = salted_lookup(people, known, "surname", "weight", ["canon"])
    others = entities.where("kind NOT IN ('name', 'family')").withColumn("family", none)
    rest = assigned(people.select("kind", "canon", "gender", "family").unionByName(others.select("kind", "canon", "gender", "family")), key)
    return named.unionByName(rest)


def in_format(kind: Column, match: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate with the separators, case and title of the mention; of a person its given
    name only where the mention is one."""
    chars, digits = F.split(match, ""), F.split(_digits(surrogate), "")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), digits.alias("digits"))

    def step(acc, c):
        digit = c.rlike("[0-9]")
        return F.struct((acc["at"] + digit.cast("int")).alias("at"), F.concat(acc["out"], F.when(digit, F.element_at(acc["digits"], acc["at"] + 1)).otherwise(c)).alias("out"), acc["digits"].alias("digits"))

    rest = lambda acc: F.array_join(F.slice(acc["digits"], acc["at"] + 1, F.greatest(F.size(acc["digits"]) - acc["at"], F.lit(0))), "")
    filled = F.aggregate(chars, start, step, lambda acc: F.concat(acc["out"], rest(acc)))
    named = F.concat(F.regexp_extract(match, rf"^({_TITLE} )", 1), F.when(given, F.substring_index(surrogate, " ", 1)).otherwise(surrogate))
    loud = match.rlike("[A-Z]") & ~match.rlike("[a-z]")
    return F.when(kind.isin("email", "ip"), F.when((kind == "email") & loud, F.upper(surrogate)).otherwise(surrogate)).when(kind.isin("name", "family"), named).otherwise(filled)


# Marks in a text: ESCAPE stands before the codes of the three marks where the text itself has them.
ESCAPE, BEGIN, END = "\u0001", "\u0002", "\u0003"
CODES = {ESCAPE: "\u0004", BEGIN: "\u0005", END: "\u0006"}


def _escaped(text: Column, back: bool = False) -> Column:
    out = text
    for mark, code in reversed(CODES.items()) if back else CODES.items():
        out = F.replace(out, F.lit(ESCAPE + code), F.lit(mark)) if back else F.replace(out, F.lit(mark), F.lit(ESCAPE + code))
    return F.when(text.contains(ESCAPE) if back else text.rlike(f"[{ESCAPE}-{END}]"), out).otherwise(text)


def _people(marked: Column) -> Column:
    """The titled names of a marked text, without their titles."""
    return F.array_distinct(F.regexp_extract_all(marked, F.lit(f"{BEGIN}{_TITLE} ([^{END}]+){END}"), F.lit(1)))


def marked_rows(rows: DataFrame) -> DataFrame:
    """rows(id, text) to (id, template, hits): the text with BEGIN for each entity, and the
    entities in order, as structs (text, kind, canon, gender, given)."""
    rows = rows.select("id", F.regexp_replace(_escaped(F.col("text")), ENTITY, f"{BEGIN}$0{END}").alias("marked"))
    rows = rows.withColumn("names", F.when(F.col("marked").contains(BEGIN), _people(F.col("marked"))).otherwise(F.array().cast("array<string>")))
    whole = F.filter("names", lambda x: x.contains(" "))
    parts = F.flatten(F.transform("names", lambda x: F.array(x, F.substring_index(x, " ", -1), F.substring_index(x, " ", 1))))
    longest = F.transform(F.array_sort(F.transform(F.array_distinct(parts), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda x: F.concat(F.lit(r"\Q"), x["x"], F.lit(r"\E")))
    again = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    rows = rows.withColumn("again", F.when(F.size("names") > 0, again)).withColumn("whole", whole)
    mark = lambda x: F.regexp_replace(x, F.col("again"), F.lit(f"{BEGIN}$0{END}"))
    tail = lambda x: F.substr(x, F.instr(x, END) + 1)
    further = F.array_join(F.transform(F.split("marked", BEGIN, -1), lambda x, i: F.when(i == 0, mark(x)).otherwise(F.concat(F.substring_index(x, END, 1), F.lit(END), mark(tail(x))))), BEGIN)
    rows = rows.withColumn("marked", F.when(F.col("again").isNotNull(), further).otherwise(F.col("marked")))

    plain = lambda x: F.struct(x.alias("text"), F.lit(False).alias("hit"))
    cut = lambda x, i: F.when(i == 0, F.array(plain(x))).otherwise(F.concat(_parts(F.substring_index(x, END, 1)), F.array(plain(tail(x)))))
    parts = F.flatten(F.transform(F.split("marked", BEGIN, -1), cut))

    def entity(part):
        kind, name = kind_of(part["text"]), untitled(part["text"])
        alone = (kind == "name") & ~name.contains(" ")
        ends, begins = F.exists("whole", lambda w: w.endswith(F.concat(F.lit(" "), name))), F.filter("whole", lambda w: w.startswith(F.concat(name, F.lit(" "))))
        given = alone & (name == part["text"]) & ~ends & ~F.array_contains("names", name) & (F.size(begins) > 0)
        kind = F.when(alone & ~given, "family").otherwise(kind)
        return F.struct(part["text"].alias("text"), kind.alias("kind"), F.when(given, F.get(begins, F.lit(0))).otherwise(canonical(kind, part["text"])).alias("canon"), F.when(kind == "name", gender_of(part["text"])).alias("gender"), given.alias("given"))

    rows = rows.withColumn("parts", F.when(F.col("marked").contains(BEGIN), F.transform(parts, lambda x: F.struct(x["text"].alias("text"), (x["hit"] & kind_of(x["text"]).isNotNull()).alias("hit")))))
    template = F.array_join(F.transform("parts", lambda x: F.when(x["hit"], F.lit(BEGIN)).otherwise(x["text"])), "")
    hits = F.transform(F.filter("parts", lambda x: x["hit"]), entity)
    return rows.select("id", F.when(F.col("parts").isNull(), F.col("marked")).otherwise(template).alias("template"), hits.alias("hits"))


def surrogates(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_entities, text with surrogates.

    A text without entities stays as it is; a null text counts as empty. Rows that repeat an id
    are handled each. Ids may be null. An empty table gives an empty result. Other columns are
    not read. Keep the key secret: with it, surrogates can be linked to guesses. A given name
    that two people of a text share stands for the first of them in the text.
    """
    rows = marked_rows(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "marked")  # row numbers are fixed by the file
    some = rows.where("size(hits) > 0")
    mentions = some.select("row", F.posexplode("hits").alias("at", "hit")).select("row", "at", "hit.*")
    mentions = mentions.withColumn("entity", F.concat_ws("|", "kind", "canon"))
    found = mentions.groupBy("entity").agg(F.first("kind").alias("kind"), F.first("canon").alias("canon"), F.min("gender").alias("g1"), F.max("gender").alias("g2"), F.count(F.lit(1)).alias("weight"))
    found = written(found.select("entity", "kind", "canon", F.when(F.col("g1") == F.col("g2"), F.col("g1")).otherwise("n").alias("gender"), "weight"), "entities")
    known = surrogates_of(found.select("kind", "canon", "gender"), key).select(F.concat_ws("|", "kind", "canon").alias("entity"), "surrogate")
    known = written(found.select("entity", "weight").join(known, "entity"), "known")
    chosen = salted_lookup(mentions.drop("canon", "gender"), known, "entity", "weight", ["row", "at"])
    news = chosen.select("row", F.struct("at", in_format(F.col("kind"), F.col("text"), F.col("surrogate"), F.col("given")).alias("new")).alias("x"))
    news = news.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("news"))
    pieces = some.select("row", "id", F.split("template", BEGIN, -1).alias("pieces")).join(news, "row")
    whole = F.array_join(F.zip_with("pieces", F.col("news.new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    changed = pieces.select("id", F.size("news").cast("long").alias("n"), whole.alias("text"))
    same = rows.where("coalesce(size(hits), 0) <= 0").select("id", F.lit(0).cast("long").alias("n"), F.col("template").alias("text"))
    return same.unionByName(changed).select(F.col("id").alias(id_col), F.col("n").alias("n_entities"), _escaped(F.col("text"), back=True).alias("text"))


def op10_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """The key is the session's secret (KEY_SETTING); without one, a key of this call alone."""
    return surrogates(documents(spark, sf_dir), spark.conf.get(KEY_SETTING, None) or token_hex(32))
