"""Keyed surrogates for personal data, built from DataFrame functions alone.

Texts are cut at detected entities. Each distinct entity gets a replacement of its own type: digits become digits and
letters letters of the same case and script, separators stay, cards that pass the checksum go on passing it,
networks' private ranges and phones' country codes are kept, and names match gender (from the title before them) and
script. Replacements derive from a key by SHA-512, so the same entity gets the same replacement in every
document. A candidate is taken only if no other entity has it and no entity of the corpus is called so; the
rest try again with the next counter, and names and addresses grow longer with it. A form of fixed length may have too
few values for that: what is left after ``ROUNDS`` gets its whole form dealt anew, each entity the value of the next one
in a keyed order of the form's own entities. So distinct entities stay distinct, and none keeps its value, unless it is
the only one of a form that the rounds can't change (it then has no letter or digit).

A name found behind a title is also replaced where it stands alone in the same text, by the same surrogate. A given name
behind a title without gender is taken as the gendered one of the corpus, if there is one. Names that no title precedes
anywhere in their text are not detected, nor are other spellings (case, inflection) of a found name.

The key comes from the session's ``spark.curatrix.surrogate.key``; without it, a fixed one that keeps nothing secret.

Defined cases: null texts stay null and texts without entities stay as they are; a very long text is searched whole;
equal entities tie to one surrogate; repeated rows get equal texts; rows with a null id are kept; an empty table gives an
empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curatrix.llm.common import written

KEY, ROUNDS = "surrogate key", 8

#: Titles by gender, given names by gender and script, name syllables, letters by script.
TITLES = {"m": "Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|господин|κύριος", "f": "Mrs|Ms|Miss|Madam|Frau|Fräulein|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|госпожа|κυρία", "n": "Dr|Prof|Professor|Doctor"}
GIVEN = {
    ("m", "latin"): "Adam Albert Alexander Anton Arthur Ben Bruno Carl Daniel David Edgar Emil Erik Felix Frank Fred Georg Gustav Hugo Ivan Jacob James Jonas Julian Karl Leo Louis Lucas Marco Martin Max Nils Oscar Otto Paul Peter Robert Simon Thomas Victor",
    ("f", "latin"): "Ada Agnes Alice Amelia Anna Bella Bianca Carla Clara Diana Edith Elena Elsa Emma Eva Flora Frida Greta Hanna Helena Ida Inga Iris Jana Julia Karin Klara Laura Lena Lisa Lucia Maria Marta Mina Nora Olga Paula Rosa Sara Vera",
    ("n", "latin"): "Alex Andrea Ariel Bo Charlie Chris Dana Eden Eli Fran Gabriel Jamie Jo Jules Kai Kim Kit Lee Lou Luca Max Mika Morgan Nicola Noa Noel Pat Quinn Ray Robin Rowan Sam Sascha Sky Terry Toni Val Vivian Yael Yuri",
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Юрий",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Раиса Юлия",
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λουκάς Μάριος Νίκος Πέτρος Σπύρος Χρήστος",
    ("f", "greek"): "Άννα Βασιλική Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Λένα Μαρία Νίκη Σοφία Χριστίνα",
    ("m", "han"): "伟 强 磊 军 勇 杰 涛 明 超 刚 平 辉 鹏 华 飞 鑫",
    ("f", "han"): "芳 娜 敏 静 丽 艳 娟 霞 秀 燕 玲 桂 丹 萍 红 玉",
}
SYLLABLES = {
    "latin": "bar ben bor bran cal car cor dal dan del dor el er fal fen fer gal gan gor hal han har hol in jan kal kar kel kor lan lar len lin lor mal man mar mel mer mon mor nal nel nor or pal pel per ral ran rel ren ros sal san sel sol tal tan tel tor val van vel ver vin wal wen",
    "cyrillic": "бар вел гор дан жар зор кал лан мор нов ор пав рос сол тар фед хар чер шал яр",
    "greek": "αν βελ γαρ δαν ελ ζαν θαλ καρ λαμ μαρ νικ παλ ραν σολ ταν φαν χαρ ψαλ",
    "han": "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗",
}
LETTERS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "han": "山水木火土金日月天地人大小中上下左右东西南北春夏秋冬", "latin": "áàâäéèêëíìîïóòôöúùûüñç"}

_ANY = "|".join(TITLES.values())
_WORD = r"\p{L}\p{N}"
_NAME = r"[\p{Lu}\p{IsHan}](?:[\p{L}'’-]*\p{L})?"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+-])[{_WORD}._%+-]++@(?:[{_WORD}-]++(?:\.[{_WORD}-]++)*+(?<=\.\p{{L}}{{2,63}})|[{_WORD}-]++(?:\.[{_WORD}-]++){{0,8}}\.\p{{L}}{{2,}})",
    "iban": rf"(?<![{_WORD}])[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_WORD}])",
    "ip": rf"(?<![{_WORD}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){{3}}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![{_WORD}]|\.[0-9])",
    "card": rf"(?<![{_WORD}])(?:[0-9]{{4}}[ -]?){{3}}[0-9]{{1,7}}(?![{_WORD}])",
    "ssn": rf"(?<![{_WORD}-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![{_WORD}-])",
    "phone": rf"(?<![{_WORD}])(?:\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{1,5}}\)|[0-9]{{1,5}})|\([0-9]{{2,5}}\)|0[0-9]{{1,4}}|[0-9]{{3}}(?=[.-][0-9]{{3}}[.-][0-9]{{4}}))(?:[ ./-]?[0-9]{{2,5}}){{2,4}}(?![{_WORD}])",
    "person": rf"(?<![{_WORD}])(?:{_ANY})\.? {_NAME}(?: {_NAME})?",
}
#: No kind begins inside a word; said once in front, most places fail at once.
PATTERN = rf"(?<![{_WORD}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: A text without any of these has no entity; cheaper to test than the patterns.
HINT = rf"[0-9@]|(?=[{''.join(sorted({t[0] for t in _ANY.split('|')}))}])(?:{_ANY})\.? "


def _chars(x: str) -> str:
    return f"split({x}, '')"


def _list(words: str) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def _pick(array: str, number: str) -> str:
    return f"element_at({array}, 1 + CAST({number} % size({array}) AS INT))"


def _number(at: int) -> str:
    """A number of 28 bits from the digest ``h``."""
    return f"CAST(conv(substr(h, {at}, 7), 16, 10) AS BIGINT)"


def _swapped(x: str) -> str:
    """Every letter and digit replaced by one of its own class, by the digest ``h``."""
    byte = "CAST(conv(substr(h, 1 + (2 * k) % 126, 2), 16, 10) AS INT)"

    def letter(letters: str) -> str:
        low = f"substr('{letters}', 1 + {byte} % {len(letters)}, 1)"
        return f"CASE WHEN c RLIKE '\\\\p{{Lu}}' THEN upper({low}) ELSE {low} END"

    cases = [f"WHEN c RLIKE '[0-9]' THEN CAST({byte} % 10 AS STRING)", f"WHEN c RLIKE '[A-Za-z]' THEN {letter('abcdefghijklmnopqrstuvwxyz')}"]
    cases += [f"WHEN c RLIKE '\\\\p{{Is{name.capitalize()}}}' THEN {letter(letters)}" for name, letters in LETTERS.items()]
    return f"array_join(transform({_chars(x)}, (c, k) -> CASE {' '.join(cases)} ELSE c END), '')"


def _luhn(digits: str) -> str:
    """Checksum of a string of digits, the last one counted once."""
    twice = "2 * CAST(c AS INT)"
    return f"aggregate(transform({_chars(f'reverse({digits})')}, (c, k) -> CASE WHEN k % 2 = 1 THEN {twice} - IF({twice} > 9, 9, 0) ELSE CAST(c AS INT) END), 0, (a, b) -> a + b) % 10"


def _card(x: str) -> str:
    digits = "regexp_replace({}, '[^0-9]', '')"
    plain = f"concat(substr({x}, 1, 1), substr({_swapped(x)}, 2))"
    fixed = f"concat(substr({plain}, 1, length({x}) - 1), CAST((10 - {_luhn(f'''concat({digits.format(f'substr({plain}, 1, length({x}) - 1)')}, '0')''')}) % 10 AS STRING))"
    return f"IF({_luhn(digits.format(x))} = 0, {fixed}, {plain})"


def _ip(x: str) -> str:
    octets = [f"CAST({_number(1 + 8 * k)} % {n} + {low} AS STRING)" for k, (n, low) in enumerate(((223, 1), (256, 0), (256, 0), (254, 1)))]
    keep = f"regexp_extract({x}, '^(10|127|192\\\\.168|172\\\\.[0-9]+)\\\\.', 1)"
    left = f"size(split({keep}, '\\\\.'))"
    return f"CASE WHEN {keep} = '' THEN concat_ws('.', {', '.join(octets)}) WHEN {left} = 1 THEN concat_ws('.', {keep}, {', '.join(octets[1:])}) ELSE concat_ws('.', {keep}, {', '.join(octets[2:])}) END"


def _kept_front(x: str, front: str) -> str:
    """What matches ``front`` stays, the rest is swapped."""
    return f"concat(regexp_extract({x}, '{front}', 0), substr({_swapped(x)}, 1 + length(regexp_extract({x}, '{front}', 0))))"


def _email(x: str) -> str:
    end = f"length(regexp_extract({x}, '\\\\.[^.]*$', 0))"
    longer = f"IF(attempt > 1, translate(substr(h, 100, 2 * attempt), '0123456789', 'ghijklmnop'), '')"
    return f"concat({longer}, substr({_swapped(x)}, 1, length({x}) - {end}), substr({x}, length({x}) - {end} + 1))"


def _surname(script: str) -> str:
    parts = _list(SYLLABLES[script])
    joined = f"concat({_pick(parts, _number(1))}, {_pick(parts, _number(9))}, IF(attempt > 0, {_pick(parts, _number(17))}, ''), IF(attempt > 2, {_pick(parts, _number(25))}, ''), IF(attempt > 4, concat({_pick(parts, _number(41))}, {_pick(parts, _number(49))}, {_pick(parts, _number(57))}), ''))"
    return joined if script == "han" else f"initcap({joined})"


def _given(gender: str, script: str) -> str:
    names = _list(GIVEN.get((gender, script)) or GIVEN[("m", script)] + " " + GIVEN[("f", script)])
    extra = _surname(script) if script == "han" else f"concat('-', {_pick(names, _number(33))}, IF(attempt > 2, concat('-', {_surname(script)}), ''))"
    return f"concat({_pick(names, _number(1))}, IF(attempt > 0, {extra}, ''))"


def candidate(key: str) -> Column:
    """The replacement that ``kind`` and ``value`` get at ``attempt``; ``h`` is the keyed digest."""
    cases = [
        f"WHEN kind = 'email' THEN {_email('value')}",
        f"WHEN kind = 'iban' THEN {_kept_front('value', '^[A-Z]{2}')}",
        f"WHEN kind = 'ip' THEN {_ip('value')}",
        f"WHEN kind = 'card' THEN {_card('value')}",
        f"WHEN kind = 'phone' THEN {_kept_front('value', '^([+][0-9]{1,3}(?=[ .(-])|[+][0-9]|0)?')}",
        *[f"WHEN kind = 'surname:{s}' THEN {_surname(s)}" for s in SYLLABLES],
        *[f"WHEN kind = 'given:{g}:{s}' THEN {_given(g, s)}" for g in TITLES for s in SYLLABLES],
    ]
    return F.expr(f"CASE {' '.join(cases)} ELSE {_swapped('value')} END")


def _dealt(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate: of each kind and form every entity gets the value of the next one in a keyed order, the
    last one that of the first. Order is kept inside 4,096 buckets of the digest; a bucket's last entity goes on with the
    first of the next bucket that has any, so that a form which very many entities share isn't one task's."""
    form = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), r"\p{Lu}", "A"), r"\p{L}", "a")
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("dealt"), "kind", "value"), 256)
    whole = F.col("kind").rlike("^(?:surname|given):")
    rows = entities.select("kind", "value", F.when(whole, "").otherwise(form).alias("form"), h.alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    place = ["kind", "form"]
    following = F.lead("value").over(W.partitionBy(*place, "bucket").orderBy("h", "value"))
    firsts = rows.groupBy(*place, "bucket").agg(F.min_by("value", F.struct("h", "value")).alias("head"))
    w = W.partitionBy(*place).orderBy("bucket")
    turn = F.coalesce(F.lead("head").over(w), F.first("head").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = firsts.select(*place, "bucket", turn.alias("turn"))
    return rows.withColumn("following", following).join(heads, [*place, "bucket"]).select("kind", "value", "form", F.coalesce("following", "turn").alias("surrogate"))


def surrogates(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value). Rounds stop when every entity has one; forms that still have
    entities without are dealt anew among themselves (``_dealt``)."""
    every = written(entities.select("kind", "value").distinct())
    names = every.select("kind", F.col("value").alias("surrogate"))
    todo, done = every, None
    for attempt in range(rounds):
        fresh = todo.withColumn("attempt", F.lit(attempt)).withColumn("h", F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "value", "attempt"), 512)).withColumn("surrogate", candidate(key))
        free = fresh.join(names, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        taken = free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        done = written(taken if done is None else done.unionByName(taken))
        todo = written(todo.join(done.select("kind", "value"), ["kind", "value"], "left_anti"))
        if todo.isEmpty():
            return done
    dealt = _dealt(every, key)
    forms = dealt.join(todo, ["kind", "value"], "left_semi").select("kind", "form").distinct()
    anew = written(dealt.join(forms, ["kind", "form"], "left_semi").select("kind", "value", "surrogate"))
    return anew.unionByName(done.join(anew.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "surrogate"))


def _pieces(text: Column) -> Column:
    """The text as an array of (kind, value): kind null for plain text between entities, so that joining all values
    gives the text again. Names are pieces of their own behind their title."""
    text_between, found = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    plain = lambda x: F.array(F.struct(F.lit(None).cast("string").alias("kind"), x.alias("value")))
    return F.flatten(F.zip_with(text_between, found, lambda gap, e: F.when(e.isNull(), plain(gap)).otherwise(F.concat(plain(gap), _typed(e)))))


def _typed(e: Column) -> Column:
    """Pieces of one entity."""
    one = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    title = F.regexp_extract(e, rf"^(?:{_ANY})\.? ", 0)
    rest = F.substring_index(e, " ", -1)
    first = F.regexp_extract(e, rf"^(?:{_ANY})\.? ({_NAME}) {_NAME}$", 1)
    gender = F.when(title.rlike(rf"^(?:{TITLES['f']})\.? $"), "f").when(title.rlike(rf"^(?:{TITLES['m']})\.? $"), "m").otherwise("n")
    script = lambda x: F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").when(x.rlike(r"\p{IsHan}"), "han").otherwise("latin")
    nothing = F.lit(None).cast("string")
    # what shows possession is no part of the name
    owner = F.regexp_extract(rest, "['’]s$", 0)
    rest = F.regexp_replace(rest, "['’]s$", "")
    surname = one(F.concat(F.lit("surname:"), script(rest)), rest)
    person = F.when(first == "", F.array(one(nothing, title), surname, one(nothing, owner))).otherwise(F.array(one(nothing, title), one(F.concat(F.lit("given:"), gender, F.lit(":"), script(first)), first), one(nothing, F.lit(" ")), surname, one(nothing, owner)))
    out = None
    for kind, pattern in PATTERNS.items():
        if kind != "person":
            test, value = e.rlike(f"^(?:{pattern})$"), F.array(one(F.lit(kind), e))
            out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(person)


def _mentions(pieces: Column, names: Column) -> Column:
    """The pieces, plain text cut again where one of the text's own names stands alone."""
    # in descending order a name comes before its own beginnings
    words = F.array_join(F.sort_array(F.array_distinct(F.transform(names, lambda e: e["value"])), asc=False), "|")
    pattern = F.concat(F.lit(rf"(?<![{_WORD}])(?:"), words, F.lit(rf")(?![{_WORD}])"))
    piece = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    plain = lambda x: F.array(piece(F.lit(None).cast("string"), x))
    name = lambda w: F.array(piece(F.element_at(F.filter(names, lambda e: e["value"] == w), 1)["kind"], w))
    cut = lambda x: F.flatten(F.zip_with(F.split(x, pattern, -1), F.regexp_extract_all(x, pattern, F.lit(0)), lambda gap, w: F.when(w.isNull(), plain(gap)).otherwise(F.concat(plain(gap), name(w)))))
    return F.when(F.size(names) == 0, pieces).otherwise(F.flatten(F.transform(pieces, lambda p: F.when(p["kind"].isNull(), cut(p["value"])).otherwise(F.array(piece(p["kind"], p["value"]))))))


def _kinds(listed: DataFrame) -> DataFrame:
    """same, kind, value, and ``own``: the kind whose surrogate is taken. Given names without gender go with the first
    gendered kind that the corpus has of them."""
    given = F.col("kind").startswith("given:")
    script = F.substring_index("kind", ":", -1)
    gendered = listed.where(given & ~F.col("kind").startswith("given:n:")).groupBy(script.alias("script"), "value").agg(F.min("kind").alias("other"))
    open_kind = F.when(F.col("kind").startswith("given:n:"), script)
    return listed.withColumn("script", open_kind).join(gendered, ["script", "value"], "left").select("same", "kind", "value", F.coalesce("other", "kind").alias("own"))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents without any entity (doc_id, text), and those with some (doc_id, pieces, and a key for equal texts)."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    with_some = plain.where(has).select("doc_id", _pieces(F.col("text")).alias("pieces"), F.sha2(F.col("text").cast("binary"), 256).alias("same"))
    return plain.where(~has), with_some


def replaced(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities. Only entities are shuffled to find surrogates, once per distinct
    text; texts with entities move once to meet theirs, all others stay where they are."""
    key = key or docs.sparkSession.conf.get("spark.curatrix.surrogate.key", KEY)
    clean, found = detected(docs, id_col, text_col)
    found = written(found)
    known = lambda p: p["kind"].isNotNull()
    per_text = written(found.select("same", F.array_distinct(F.filter("pieces", known)).alias("entities")).groupBy("same").agg(F.first("entities").alias("entities")))
    listed = written(_kinds(per_text.select("same", F.explode("entities").alias("e")).select("same", "e.kind", "e.value")))
    chosen = surrogates(listed.select(F.col("own").alias("kind"), "value"), key).withColumnRenamed("kind", "own")
    lookup = listed.join(chosen, ["own", "value"]).groupBy("same").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "value"), "surrogate"))).alias("lookup"))
    swap = F.transform("pieces", lambda p: F.when(known(p), F.element_at("lookup", F.concat_ws("\u0001", p["kind"], p["value"]))).otherwise(p["value"]))
    names = F.array_distinct(F.filter("pieces", lambda p: known(p) & p["kind"].rlike("^(?:surname|given):")))
    cut = found.withColumn("names", names).withColumn("pieces", _mentions(F.col("pieces"), F.col("names")))
    done = cut.join(lookup, "same").select("doc_id", F.array_join(swap, "").alias("text"), F.size(F.filter("pieces", known)).cast("long").alias("n_entities"))
    return clean.select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")).unionByName(done)
