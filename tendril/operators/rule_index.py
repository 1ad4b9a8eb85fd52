"""An index of very many text rules, so that records meet only the rules that may hold for them.

Every rule is filed under what a record must have for the rule to hold: an agency or a
state of its lists, a watched supplier, or for each of its terms three letters that stand
in one of the term's words.  Of a term's letters the rarest are taken.  Words count as
substrings, so a record is looked up under those letters that it has, by an equi-join;
the full condition decides.  A record meets a rule by the first of its terms that holds,
so nothing is found twice and nothing has to be made distinct.

Of many rules, the distinct words are looked for in the distinct words of the texts
instead, and a record is read once, not for each rule that may hold for it.  A rule of
one or two words is then found under the rarer one by an equi-join, and a bit of the
record says whether it has the other; whether any other rule holds is a bit of the
record too.  Rules that have no conditions but their terms are not looked at again.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.catalog import checkpointed, stored

#: Rules that are sent to every executor at once; more are taken in parts of this size.
RULES_AT_ONCE = 10_000
#: So many grams are looked for in a record one by one; for more, the words of the rules are looked for in those of all texts.
FEW_GRAMS = 100
#: Rules of one or two words, and of no other conditions, that are sent at once: each is a number, a bit and its name.
PLAIN_AT_ONCE = 500_000
#: Texts that are sent to Python at once, and how many bits of them are held there as bytes.
TEXTS_AT_ONCE, BITS_AT_ONCE = 1_000, 1 << 24
#: Records that are worth a task, and pairs of records and rules that one task takes at most.
RECORDS_A_TASK, PAIRS_A_TASK = 250, 500_000_000
#: Distinct words of texts that a task's process remembers the words of rules of.
TOKENS_KEPT = 800_000
#: What every record has: rules that can be filed under nothing else are.
ANY = "\x01"
_AGENCY, _STATE, _SUPPLIER = "\x01a", "\x01s", "\x01p"
#: Ways by which a record met a rule, besides the number of a term.
BY_LIST, BY_SUPPLIER = -1, -2


def term_holds(folded: Column, term: Column) -> Column:
    """Whether all words of a term are in the text; a word without wildcards is looked up as it is."""
    return F.forall(term, lambda w: F.when(w["wild"], F.call_function("like", folded, w["pattern"])).otherwise(F.contains(folded, w["word"])))


def letters(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, each once; linear in its length."""
    chars = F.split(text, "")
    runs = chars
    for k in range(1, size):  # null where a text ends within the run
        runs = F.zip_with(runs, F.slice(chars, k + 1, F.length(text)), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(runs, lambda x: x.isNotNull()))


def _runs(word: str) -> set[str]:
    """Three letters of each stretch of a word between wildcards, or two where it has no more."""
    parts = [p for p in re.split("[%_]", word) if len(p) > 1]
    return {p[k : k + 3] for p in parts for k in range(max(1, len(p) - 2))}


def letter_counts(records: DataFrame, folded: str) -> DataFrame:
    """``gram, n``: how many records have each run of two and three letters; for tables that many rules are filed for."""
    return records.select(F.explode(F.concat(letters(F.col(folded), 3), letters(F.col(folded), 2))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def postings(rules: DataFrame, lists: dict[str, str], suppliers: bool, terms_needed: bool, counts: DataFrame | None = None) -> list[tuple[str, int, int]] | None:
    """``(gram, monitor_id, way)``: where each rule is filed; None if there are more than ``RULES_AT_ONCE``.

    ``rules`` has ``_want`` (terms as words) and ``_terms``, how many terms were asked
    for; ``lists`` maps columns of lists to marks, the most selective first.  Without
    ``counts`` a gram is rare if few terms of these rules have it.
    """
    words = F.transform("_want", lambda t: F.transform(t, lambda w: w["word"])).alias("want")
    held = rules.select("monitor_id", "_terms", words, *lists, *(["suppliers"] if suppliers else [])).limit(RULES_AT_ONCE + 1).collect()
    if len(held) > RULES_AT_ONCE:
        return None
    grams = {(r.monitor_id, k): set().union(*map(_runs, term)) for r in held for k, term in enumerate(r.want)}
    if counts is None:
        frequent = Counter(g for each in grams.values() for g in each)
    else:
        wanted = rules.sparkSession.createDataFrame([(g,) for g in set().union(*grams.values())], "gram string")
        frequent = Counter({r.gram: r.n for r in counts.join(F.broadcast(wanted), "gram").collect()})
    filed = []
    for r in held:
        best = [min(grams[r.monitor_id, k], key=lambda g: (frequent[g], -len(g), g), default=ANY) for k in range(len(r.want))]
        by = next(([mark + x for x in r[c] if x is not None] for c, mark in lists.items() if r[c] and (c == next(iter(lists)) or not r._terms or ANY in best)), None)
        if r._terms or not terms_needed:
            if by is None and r._terms:
                filed += [(g, r.monitor_id, k) for k, g in enumerate(best)]
            else:
                filed += [(g, r.monitor_id, BY_LIST) for g in dict.fromkeys([ANY] if by is None else by)]
        if suppliers:
            filed += [(_SUPPLIER + x, r.monitor_id, BY_SUPPLIER) for x in dict.fromkeys(r.suppliers or ()) if x is not None]
    return filed


def _parts(rules: DataFrame, *how, bit: int = 0) -> Iterator[tuple[DataFrame, list[tuple[str, int, int]]]]:
    """``rules`` in parts that can be sent, and where the rules of each are filed."""
    filed = postings(rules, *how)
    if filed is not None:
        yield rules, filed
        return
    side = F.shiftright(F.xxhash64("monitor_id"), bit).bitwiseAND(F.lit(1))
    for k in (0, 1):
        yield from _parts(rules.where(side == k), *how, bit=bit + 1)


def _filed_words(words: dict[str, int]) -> list[tuple[str, str, int]]:
    """``(gram, word, number)``: each word under one of its runs of eight letters that the fewest words have, or under all of it where it is shorter."""
    runs = {w: {w[k : k + 8] for k in range(max(1, len(w) - 7))} for w in words}
    frequent = Counter(g for each in runs.values() for g in each)
    return [(min(each, key=lambda g: (frequent[g], g)), w, words[w]) for w, each in runs.items()]


def _finder(words: dict[str, int]) -> Callable[[str], list[int]]:
    """A function from a word of a text to the numbers of those ``words`` that stand in it."""
    filed, own = _filed_words(words), {}
    for g, w, n in filed:
        own.setdefault(g, []).append((w, n))
    sizes, grams, runs = sorted({len(g) for g in own}), frozenset(own), {}

    def found(token: str) -> list[int]:
        size = len(token)
        if size not in runs:
            runs[size] = [slice(k, k + n) for n in sizes for k in range(size - n + 1)]
        return [n for g in grams.intersection(map(token.__getitem__, runs[size])) for w, n in own[g] if w in token]

    return found


class _Texts:
    """The distinct texts of some records with their words, which are written once and read for every part of the rules that asks for them."""

    def __init__(self, records: DataFrame, folded: str):
        self.spark, self.folded = records.sparkSession, F.col(folded)
        self.ident = F.unhex(F.sha2(self.folded, 256))
        self.records = records
        self._words = None

    def texts(self) -> DataFrame:
        return self.records.select(self.ident.alias("_text"), self.folded.alias("_folded")).dropDuplicates(["_text"])

    def words(self) -> DataFrame:
        if self._words is None:
            self._words = checkpointed(self.texts().select("_text", F.explode_outer(F.array_distinct(F.split("_folded", r"\s+"))).alias("_token")))
        return self._words

    def matching(self, wild: dict[str, int]) -> DataFrame:
        """``_text`` with the numbers of those words with wildcards that it matches, as ``_wild``; texts that match none are left out.

        Such a word may go across spaces; it is looked for in the texts that hold its
        longest stretch between wildcards.
        """
        stretch = {w: max((p for p in re.split("[%_]", w) if len(p) > 1), key=len, default="") for w in wild}
        number = {p: n for n, p in enumerate(sorted(set(stretch.values()) - {""}))}
        asked = []
        if number:
            filed = _filed_words(number)
            table = self.spark.createDataFrame(filed, "_gram string, _word string, _n int")
            runs = F.concat(*[letters(F.col("_token"), n) for n in sorted({len(g) for g, _, _ in filed})])
            held = self.words().select("_token").distinct().withColumn("_gram", F.explode_outer(runs)).join(F.broadcast(table), "_gram").where(F.contains("_token", F.col("_word")))
            asked.append(self.words().join(held.select("_token", "_n"), "_token").select("_text", "_n").distinct())
        if "" in stretch.values():  # it has no stretch: every text is asked
            asked.append(self.texts().select("_text", F.explode(F.array(F.lit(-1))).alias("_n")))
        like = [(number.get(stretch[w], -1), "%" + w.replace("\\", "\\\\") + "%", n) for w, n in wild.items()]
        table = self.spark.createDataFrame(like, "_n int, _pattern string, _number int")
        pairs = reduce(DataFrame.unionByName, asked).join(F.broadcast(table), "_n").join(self.texts(), "_text")
        return pairs.where(F.call_function("like", F.col("_folded"), F.col("_pattern"))).groupBy("_text").agg(F.collect_list("_number").alias("_wild"))


def _told(rules: list[tuple[list[list[int]], list[list[int]]]]):
    """A function from the words that texts have, a row of booleans each, to the rules that hold for them: some term whole, and none of the excluded."""

    def flat(side: int):
        terms = [(r, t) for r, rule in enumerate(rules) for t in rule[side]]
        lengths = np.array([len(t) for _, t in terms], dtype=np.int64)
        owner = np.array([r for r, _ in terms], dtype=np.int64)
        return np.array([n for _, t in terms for n in t], dtype=np.int64), np.cumsum(lengths) - lengths, *np.unique(owner, return_index=True)

    want, ban = flat(0), flat(1)

    def some(there: np.ndarray, need: np.ndarray, begins: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(there), len(rules)), dtype=bool)
        if len(owner):
            out[:, owner] = np.logical_or.reduceat(np.logical_and.reduceat(there[:, need], begins, axis=1), first, axis=1)
        return out

    return lambda there: some(there, *want) & ~some(there, *ban)


_kept: dict[str, dict[str, bytes]] = {}


def _remembered(name: str) -> dict[str, bytes]:
    """What this process has found under a name; what it has found under others is forgotten."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = {}
    elif len(_kept[name]) > TOKENS_KEPT:
        _kept[name].clear()
    return _kept[name]


def _has(found: Callable[[str], list[int]], size: int, others: list):
    """A function from texts as distinct words, and numbers that each has besides, to the numbers that each has, and to bits, one for each number.

    Numbers below ``size`` are words, those from there the rules ``others``.
    """
    width, name = -(-(size + len(others)) // 64) * 64, uuid.uuid4().hex
    step = max(1, BITS_AT_ONCE // max(width, sum(len(t) for rule in others for side in rule for t in side)))
    told = _told(others)

    def whole(tokens: pa.Array, besides: pa.Array) -> pa.Array:
        kept, coded = _remembered(name), tokens.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        for t in distinct:
            if t not in kept:
                kept[t] = array("i", found(t)).tobytes()
        numbers = [kept[t] for t in distinct]
        own, every = np.array(list(map(len, numbers)), dtype=np.int64) // 4, np.frombuffer(b"".join(numbers), dtype=np.int32)
        begins = np.cumsum(own) - own
        codes = coded.indices.to_numpy()
        ends = np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())
        more, more_ends = besides.flatten().to_numpy(), np.cumsum(besides.value_lengths().fill_null(0).to_numpy())
        has, lengths, bits = [], [], []
        for low in range(0, len(tokens), step):
            high = min(low + step, len(tokens))
            there = np.zeros((high - low, width), dtype=bool)
            first = ends[low - 1] if low else 0
            code = codes[first : ends[high - 1]]
            row = np.repeat(np.arange(high - low), np.diff(ends[low:high], prepend=first))
            n = own[code]
            there[np.repeat(row, n), every[np.repeat(begins[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
            first = more_ends[low - 1] if low else 0
            there[np.repeat(np.arange(high - low), np.diff(more_ends[low:high], prepend=first)), more[first : more_ends[high - 1]]] = True
            if others:
                there[:, size : size + len(others)] = told(there)
            packed = np.packbits(there, axis=1, bitorder="little")
            some, at = np.nonzero(packed)
            each, bit = np.nonzero(np.unpackbits(packed[some, at][:, None], axis=1, bitorder="little"))
            has.append(at[each] * 8 + bit)
            lengths.append(np.bincount(some[each], minlength=high - low))
            bits.append(packed.view(np.int64).ravel())
        offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
        together = lambda x, kind: np.concatenate([*x, np.empty(0, kind)]).astype(kind)
        lists = pa.ListArray.from_arrays(offsets(together(lengths, np.int64)), pa.array(together(has, np.int32)))
        return pa.StructArray.from_arrays([lists, pa.ListArray.from_arrays(offsets(np.full(len(tokens), width // 64)), pa.array(together(bits, np.int64)))], ["has", "bits"])

    return whole


def _numbered(words: list[str]) -> tuple[dict[str, int | None], dict[str, int], dict[str, int]]:
    """The number of each word; those of what is looked for as it is, and of what has wildcards within.

    Wildcards for any letters at the ends of a word say nothing; a word of nothing else is always there, and has no number.
    """
    core = {w: w.strip("%") for w in words}
    number = {c: n for n, c in enumerate(sorted(set(core.values()) - {""}))}
    wild = {c: n for c, n in number.items() if "%" in c or "_" in c}
    return {w: number.get(c) for w, c in core.items()}, {c: n for c, n in number.items() if c not in wild}, wild


def _by_words(texts: _Texts, records: DataFrame, plain: DataFrame | None, others: DataFrame) -> DataFrame:
    """``records``, which have these texts, with those rules that hold for them by their words.

    ``plain`` have one term of one or two words each and exclude nothing; of ``others``
    there are ``RULES_AT_ONCE`` at most.
    """
    spark = texts.spark
    ruled = others if plain is None else plain.unionByName(others)
    counted = ruled.select(F.explode(F.flatten(F.concat("_want", "_not"))).alias("w")).groupBy("w.word").agg(F.count(F.lit(1)).alias("n")).collect()
    number, looked_for, wild = _numbered([r.word for r in counted])
    find, weight = _finder(looked_for), Counter()
    for r in counted:  # a word is the rarer the fewer words of rules it stands in
        for n in find(r.word):
            weight[n] += r.n
    rules_of, filed = {}, []
    for r in others.select("monitor_id", *[F.transform(c, lambda t: F.transform(t, lambda w: w["word"])).alias(c) for c in ("_want", "_not")]).collect():
        want, ban = ([[number[w] for w in t if number[w] is not None] for t in side] for side in (r["_want"], r["_not"]))
        if all(ban):  # else it excludes every text
            rules_of.setdefault((tuple(map(tuple, want)), tuple(map(tuple, ban))), []).append(r.monitor_id)
    size = 1 + max((n for n in number.values() if n is not None), default=0)
    for n, ids in enumerate(rules_of.values(), size):
        filed += [(n, n, k) for k in ids]
    table = spark.createDataFrame(filed, "_first int, _second int, monitor_id long")
    if plain is not None:
        ranked = spark.createDataFrame([(w, weight[n], n) for w, n in number.items() if n is not None], "word string, _weight long, _n int")
        asked = plain.select("monitor_id", F.explode(F.get("_want", F.lit(0))).alias("w")).select("monitor_id", "w.word").join(F.broadcast(ranked), "word")
        ends = [f(F.struct("_weight", "_n"))["_n"].alias(c) for f, c in ((F.min, "_first"), (F.max, "_second"))]
        table = asked.groupBy("monitor_id").agg(*ends).select(*table.columns).unionByName(table)
    # one row a first word, and in it one look at the bits a second word: rules that lie together are read in a row
    each = table.groupBy("_first", "_second").agg(F.collect_list("monitor_id").alias("_ids"))
    bit = F.struct(F.shiftright("_second", 6).alias("_at"), F.expr("shiftleft(1L, _second & 63)").alias("_mask"), "_ids")
    filed_under = each.groupBy("_first").agg(F.collect_list(bit).alias("_filed"))
    # else Spark asks what a record has before the records are dealt out, and again after
    has = F.arrow_udf(_has(find, size, list(rules_of)), "has array<int>, bits array<long>").asNondeterministic()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= TEXTS_AT_ONCE:
        spark.conf.set(name, TEXTS_AT_ONCE)
    if wild:
        asking = records.withColumn("_text", texts.ident).join(texts.matching(wild), "_text", "left").drop("_text")
    else:
        asking = records.withColumn("_wild", F.array().cast("array<int>"))
    told_of = asking.withColumn("_has", has(F.array_distinct(F.split(texts.folded, r"\s+")), F.col("_wild"))).drop("_wild")
    asked_of = told_of.withColumns({"_bits": F.col("_has.bits"), "_first": F.col("_has.has")}).drop("_has").withColumn("_first", F.explode("_first"))
    looked_at = asked_of.join(F.broadcast(filed_under), "_first").select(*records.columns, "_bits", F.inline("_filed"))
    met_by = looked_at.where(F.get("_bits", F.col("_at")).bitwiseAND(F.col("_mask")) != 0)
    return met_by.select(*records.columns, F.explode("_ids").alias("monitor_id"))


def _cut(rules: DataFrame, parts: int) -> list[DataFrame]:
    return [rules] if parts == 1 else [rules.where(F.pmod(F.xxhash64("monitor_id"), F.lit(parts)) == k) for k in range(parts)]


def _by_terms(lists: dict[str, str]) -> Column:
    """Whether a rule is filed by its terms alone, and each of them has letters to be filed under."""
    lettered = F.forall("_want", lambda t: F.exists(t, lambda w: w["word"].rlike("[^%_]{2}")))
    listed = [F.coalesce(F.size(c) > 0, F.lit(False)) & (F.lit(k == 0) | ~lettered) for k, c in enumerate(lists)]
    return (F.col("_terms") > 0) & lettered & ~reduce(lambda a, b: a | b, listed, F.lit(False))


def _folded(records: DataFrame, name: str, fold: Column | None) -> DataFrame:
    return records if fold is None else records.withColumn(name, fold)


def _of_many(records: DataFrame, rules: DataFrame, on: Column, folded: str, fold: Column | None, free: Column | None) -> list[DataFrame]:
    """The records with those of many ``rules`` that hold for them, all of which are filed by their terms."""
    free = F.lit(False) if free is None else F.coalesce(free, F.lit(False))
    plain = (F.size("_want") == 1) & (F.size(F.get("_want", F.lit(0))) <= 2) & (F.size("_not") == 0)
    kinds = [free & plain, free & ~plain, ~free]
    n = rules.agg(*[F.count_if(k) for k in kinds]).first()
    if not sum(n):
        return []
    count = records.count()
    few = min(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // RECORDS_A_TASK))
    texts = _Texts(_folded(records, folded, fold), folded)
    dealt = _folded(records.repartition(max(1, few, count * sum(n) // PAIRS_A_TASK)), folded, fold)
    parts_of = lambda n, most: -(-5 * n // (4 * most))  # noqa: E731  a part by hash may have some more than its share
    one, other, bound = (rules.where(k) for k in kinds)
    parts, found = max(parts_of(n[0], PLAIN_AT_ONCE), parts_of(n[1], RULES_AT_ONCE)), []
    if parts:
        found += [_by_words(texts, dealt, p, o) for p, o in zip(_cut(one, parts), _cut(other, parts), strict=True)]
    if n[2]:
        found += [_by_words(texts, dealt, None, p).join(F.broadcast(p), "monitor_id").where(on) for p in _cut(bound, parts_of(n[2], RULES_AT_ONCE))]
    return found


def met(
    records: DataFrame, rules: DataFrame, on: Column, *, folded: str = "_folded", state: str | None = None, agency: str | None = None, supplier: str
    | None = None, terms_needed: bool = False, counts: DataFrame | None = None, fold: Column | None = None, free: Column | None = None
) -> DataFrame:
    """``records`` with each rule for which ``on`` and its terms hold, each pair once.

    ``state``, ``agency`` and ``supplier`` name columns of ``records`` that the rules'
    lists are about.  ``terms_needed``: a rule without terms holds for no record, but
    for its suppliers' ones.  Equal records are looked up alike, each for itself.
    ``fold`` is what the column ``folded`` is made of where there is none yet.
    ``free`` tells the rules for which ``on`` holds whatever the record; with it the
    records come with ``monitor_id`` only, not with the rules' other columns.
    """
    lists = ({"agencies_in": _AGENCY} if agency else {}) | ({"states": _STATE} if state else {})
    marks = [(agency, _AGENCY), (state, _STATE), (supplier, _SUPPLIER)]
    own = [F.concat(F.lit(mark), F.col(c).cast("string")) for c, mark in marks if c]
    spark, found = records.sparkSession, []
    holds = lambda t: term_holds(F.col(folded), t)
    some = F.exists("_want", holds)
    whole = some if terms_needed else (F.col("_terms") == 0) | some
    here = F.get("_want", F.col("way"))
    first = holds(here) & ~F.exists(F.slice("_want", F.lit(1), F.greatest(F.col("way"), F.lit(0))), holds)
    by_way = F.when(F.col("way") >= 0, first).when(F.col("way") == BY_LIST, whole)
    if supplier:
        watched = F.coalesce(F.array_contains("suppliers", F.col(supplier).cast("string")), F.lit(False))
        by_way = by_way.otherwise(watched & ~whole)
    how = lists, supplier is not None, terms_needed, counts
    filed = postings(rules, *how)
    many = filed is None or len({g for g, _, _ in filed if not g.startswith(ANY)}) > FEW_GRAMS
    parts = [(rules, filed)]
    if many:
        rules, by_terms = stored(rules, "rules"), _by_terms(lists)
        found = _of_many(records, rules.where(by_terms), on, folded, fold, free)
        parts = _parts(rules.where(~by_terms | F.coalesce(F.size("suppliers") > 0, F.lit(False)) if supplier else ~by_terms), *how)
    for part, filed in parts:
        wanted = {g for g, _, _ in filed if not g.startswith(ANY)}
        if many:
            every = {m for g, m, way in filed if way >= 0 and g == ANY}  # some term has no letters to be filed under: every record is asked
            filed, wanted = [x for x in filed if x[2] < 0] + [(ANY, m, BY_LIST) for m in sorted(every)], set()
        if not filed and found:
            continue
        table = spark.createDataFrame(filed, "_gram string, monitor_id long, way int")
        # an outer explode, as before a plain one Spark asks whether there is anything, which folds a text anew for each gram
        there = F.filter(F.array(*map(F.lit, sorted(wanted))).cast("array<string>"), lambda g: F.contains(F.col(folded), g))
        looked_up = _folded(records, folded, fold).withColumn("_gram", F.explode_outer(F.concat(F.array(F.lit(ANY), *own), there)))
        pairs = looked_up.join(F.broadcast(table), "_gram").join(F.broadcast(part), "monitor_id")
        found.append(pairs.where(on & by_way & ~F.exists("_not", holds)).drop("_gram", "way"))
    return reduce(DataFrame.unionByName, found if free is None else [f.select("monitor_id", *records.columns) for f in found])
