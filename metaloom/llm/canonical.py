"""Mapping of freely typed values to a canonical list."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.session import cut_lineage

#: Plain English words that connect or ask; they name no quantity in any field.
FUNCTION_WORDS = frozenset(
    "a an the our my your their of in to for by and or per from with at on is are was has have did do does how why what which who where when since until me we us i it "
    "this that these those both between".split()
)
#: Words of a name that may be left out or put in.
CONNECTORS = frozenset("of per from the a in until".split())
#: Common short forms that are no run of the word's own letters.
ALIASES = {"no": "number", "nr": "number"}
#: A word is frequent if this share of the distinct values has it, so that at most words-per-value / share are.
FREQUENT = 0.0005
#: A word beside whole names is decoration if so many values, and so many different words of names, stand beside it,
#: and no one word more often than in this share: a compound ("volume discount") keeps to its word.
SPREAD_VALUES, SPREAD_WORDS, SPREAD_SHARE = 3, 3, 0.5
#: Decorations are gathered if at least this share of the distinct values has them, so at most words-per-value / share are.
RARE = 1e-5
#: A word one letter from a canonical one is its own if more values have it than this, and this many times what a slip would have.
OWN_VALUES, OWN_TIMES = 4.0, 8.0
#: Most slips in a name, and per letter of it.
MAX_COST, COST_PER_LETTER = 3.0, 0.2
#: Names in one automaton; a longer list is searched in blocks.
BLOCK_NAMES = 100_000
PLURAL, SHORT, SLIP, SKIP = 0.2, 0.5, 1.0, 1.3


def words(text: str | None) -> list[str]:
    """The words of a typed value: no case, accents, widths, joiners or invisible marks; camel case is split, a spelled acronym is joined."""
    text = unicodedata.normalize("NFKD", text or "")
    text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf"))
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text)
    out: list[str] = []
    run = 0
    for w in re.findall(r"[^\W_]+", text.casefold()):
        if len(w) == 1 and w.isalpha() and run:
            out[-1] += w
        else:
            out.append(w)
        run = len(w) == 1 and w.isalpha()
    return out


def slips(a: str, b: str, most: int) -> int:
    """Edits, a swap of neighbours being one, from a to b; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def deletions(word: str, most: int) -> set[str]:
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


def one_slip(word: str) -> set[str]:
    """Every string one edit or swap away."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + b[1] + b[0] + b[2:] for a, b in cut if len(b) > 1}
    out |= {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters}
    return out - {word}


def allowed(word: str) -> int:
    """Slips that a typed word may be away from a canonical one."""
    return 2 if len(word) >= 5 else 1


def abbreviates(short: str, word: str) -> bool:
    """Letters of ``word`` in order, from its first, at least two left out."""
    if not 3 <= len(short) <= len(word) - 2 or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def acronyms(names: list[tuple[int, tuple[str, ...]]]) -> set[str]:
    """One-word names that begin with the initials, or are beginnings of the words, of another name of the same indicator. They allow no slips."""
    longer: dict[int, list[list[str]]] = {}
    for who, name in names:
        if len(name) > 1:
            longer.setdefault(who, []).extend([list(name), [w for w in name if w not in CONNECTORS]])
    out = set()
    for who, name in names:
        if len(name) == 1 and any(name[0].startswith("".join(w[0] for w in other)) or begins(name[0], other) for other in longer.get(who, ()) if len(other) > 1):
            out.add(name[0])
    return out


def begins(short: str, parts: list[str]) -> bool:
    """Whether ``short`` is made of beginnings of all the words, in order."""
    ends = {0}
    for w in parts:
        ends = {e + n for e in ends for n in range(1, len(w) + 1) if short.startswith(w[:n], e)}
    return len(short) in ends


@dataclass
class Matcher:
    """Finds the one canonical name that a value holds."""

    names: list[tuple[int, tuple[str, ...]]]
    frequent: dict[str, int] = field(default_factory=dict)
    #: Words learned from all values: decorations, and words one letter from a canonical one that are none of its slips.
    decorations: frozenset = frozenset()
    own: frozenset = frozenset()

    def __post_init__(self):
        self.fillers = FUNCTION_WORDS | self.decorations
        self.exact: dict[str, int] = {}
        for who, name in sorted(self.names):
            self.exact.setdefault(" ".join(name), who)
        self.mentions = ahocorasick.Automaton()
        for name, who in self.exact.items():
            self.mentions.add_word(f" {name} ", (who, name))
        if self.exact:
            self.mentions.make_automaton()
        # Needed words of each name; of equal sets the smallest id.
        self.sets: dict[frozenset, tuple[int, int]] = {}
        self.of_word: dict[str, list[frozenset]] = {}
        for name, who in self.exact.items():
            need = frozenset(w for w in name.split() if w not in CONNECTORS) or frozenset(name.split())
            letters = len("".join(need))
            self.sets[need] = min(self.sets.get(need, (who, letters)), (who, letters))
        # A set is looked up under the word that the fewest names have.
        held = Counter(w for need in self.sets for w in need)
        for need in self.sets:
            self.of_word.setdefault(min(need, key=lambda w: (held[w], w)), []).append(need)
        self.acronyms = acronyms(self.names)
        plain = {w for n in self.exact if n not in self.acronyms for w in n.split()}
        self.vocabulary = plain | self.acronyms
        self.plain = plain - CONNECTORS
        self.patterns = {w[:i] + "*" + w[i + 1 :] for w in self.plain for i in range(len(w))}
        self.by_deletion: dict[str, list[str]] = {}
        self.by_letter: dict[str, list[str]] = {}
        for w in sorted(self.plain):
            self.by_letter.setdefault(w[0], []).append(w)
            for d in deletions(w, allowed(w)):
                self.by_deletion.setdefault(d, []).append(w)
        self.foreign = {t for t in self.frequent if self.unlike(t)} | self.own
        self.foreign_by: dict[str, list[str]] = {}
        for f in sorted(self.foreign):
            self.foreign_by.setdefault(f[0], []).append(f)
        self.seen: dict[str, list[tuple[str, float]]] = {}
        self.pieces = None
        self.results: dict[str, tuple[int, int, float]] = {}

    def unlike(self, t: str) -> bool:
        """Whether a frequent word is no canonical one, nor near any, nor made of such."""
        return t not in self.vocabulary and t not in self.fillers and len(t) >= 3 and not self.joined(t) and not self.readings(t, trust=False)

    def swapped_letter(self, t: str) -> list[str]:
        """Canonical words that one other letter makes the word, if no other slip explains it."""
        if len(t) < 3 or t in self.vocabulary or t in self.fillers or not any(t[:i] + "*" + t[i + 1 :] in self.patterns for i in range(len(t))) or self.joined(t):
            return []
        near = self.readings(t, trust=False)
        ok = all(cost == SLIP and len(w) == len(t) and sum(a != b for a, b in zip(w, t, strict=True)) == 1 for w, cost in near)
        return [w for w, _ in near] if ok else []

    def joined(self, t: str) -> bool:
        """Whether canonical words and decorations, written without gaps, make up the word."""
        ends = {0}
        for e in range(1, len(t) + 1):
            if any(t[b:e] in self.vocabulary or t[b:e] in self.fillers for b in ends if e - b > 1 and e - b < len(t)):
                ends.add(e)
        return len(t) in ends

    def readings(self, t: str, trust: bool = True) -> list[tuple[str, float]]:
        """Canonical words that a typed word may stand for, with costs."""
        if t in self.vocabulary:
            return [(t, 0.0)]
        if t in self.fillers or (trust and t in self.foreign):
            return []
        if trust and t in self.seen:
            return self.seen[t]
        found: dict[str, float] = {}
        if ALIASES.get(t) in self.plain:
            found[ALIASES[t]] = SHORT
        if len(t) >= 3:
            for base, extra in ((t, 0.0), *([(t[:-1], PLURAL)] if t.endswith("s") and len(t) > 3 else [])):
                if base in self.plain:
                    found[base] = min(found.get(base, 9), extra)
                for d in deletions(base, 2 if len(base) >= 5 else 1):
                    for w in self.by_deletion.get(d, ()):
                        n = slips(base, w, allowed(w))
                        if n <= allowed(w):
                            found[w] = min(found.get(w, 9), extra + n * SLIP)
            for w in self.by_letter.get(t[0], ()):
                if abbreviates(t, w):
                    found[w] = min(found.get(w, 9), SHORT)
        out = sorted(found.items(), key=lambda x: (x[1], x[0]))
        # A slip of a word of its own is none of a canonical word that is farther.
        if trust and out and out[0][1] > SLIP and any(slips(t, f, 1) < out[0][1] for f in self.foreign_by.get(t[0], ()) if abs(len(f) - len(t)) < 2):
            out = []
        if trust:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[t] = out
        return out

    def idle(self, t: str) -> bool:
        """Whether a word left over says nothing: a decoration, a connecting word or a slip of one, or a number."""
        if t in self.fillers or t in CONNECTORS or t.isdigit():
            return True
        return t not in self.foreign and any(len(c) >= 4 and slips(t, c, 1) <= 1 for c in CONNECTORS)

    def split(self, t: str) -> list[str] | None:
        """A word written without gaps as its parts, slips allowed, by the cheapest cover from the automaton of all parts' spellings."""
        if self.pieces is None:
            spellings: dict[str, tuple[float, str]] = {}

            def offer(s: str, cost: float, w: str) -> None:
                if s and (s not in spellings or (cost, w) < spellings[s]):
                    spellings[s] = (cost, w)

            for w in [*self.plain, *CONNECTORS, *self.fillers, *self.foreign]:
                offer(w, 0.0 if len(w) > 1 else 0.6, w)
            for w in self.plain:
                offer(w + "s", PLURAL, w)
            for w in [*self.plain, *CONNECTORS]:
                for v in one_slip(w) if len(w) > 3 else ():
                    offer(v, SLIP, w)
            for short in self.frequent:  # the abbreviations in use
                near = self.readings(short)
                if near and near[0][1] == SHORT:
                    offer(short, SHORT, short)
            self.pieces = ahocorasick.Automaton()
            for s, (cost, w) in spellings.items():
                self.pieces.add_word(s, (len(s), cost, w))
            if spellings:
                self.pieces.make_automaton()
        if not len(self.pieces):
            return None
        n = len(t)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, item in self.pieces.iter(t):
            ends[end + 1].append(item)
        # A small price per part keeps covers short.
        best: list[tuple[float, int, str | None]] = [(0.0, 0, None)] + [(1e9, 0, None)] * n
        for e in range(1, n + 1):
            best[e] = (best[e - 1][0] + SKIP, e - 1, None)
            for size, cost, w in ends[e]:
                total = best[e - size][0] + cost + 0.05
                if total < best[e][0]:
                    best[e] = (total, e - size, w)
        if best[n][0] > MAX_COST + 0.5:
            return None
        out, e = [], n
        while e:
            _, start, w = best[e]
            if w is None:
                if out and out[-1][0] == "?":
                    out[-1] = ("?", t[start:e] + out[-1][1])
                else:
                    out.append(("?", t[start:e]))
            else:
                out.append((w, t[start:e]))
            e = start
        out.reverse()
        if all(w == "?" for w, _ in out):
            return None
        # A skipped letter belongs to the part before or after it.
        parts: list[str] = []
        for i, (w, s) in enumerate(out):
            if w == "?" and len(s) < 3:
                if parts:
                    parts[-1] += s
                elif i + 1 < len(out):
                    out[i + 1] = (out[i + 1][0], s + out[i + 1][1])
            else:
                parts.append(s)
        return parts

    def mentions_in(self, t: list[str]) -> list[tuple[int, str, list[str], list[str]]]:
        """Exact mentions, the longest first, none overlapping a longer: indicator, name, words before and after."""
        if not self.exact:
            return []
        text, found = f" {' '.join(t)} ", []
        for end, (who, name) in self.mentions.iter(text):
            found.append((len(name), -(end - len(name) - 1), who, name))
        taken: list[tuple[int, int]] = []
        kept = []
        for size, neg, who, name in sorted(found, reverse=True):
            start = -neg
            if all(start + size <= a or start >= b for a, b in taken):
                taken.append((start, start + size))
                kept.append((who, name, text[:start].split(), text[start + len(name) + 1 :].split()))
        return kept

    def mention(self, t: list[str]) -> tuple[int, int, float] | None:
        """The longest exact mention, if the words beside it decorate."""
        for who, name, lo, hi in self.mentions_in(t):
            if (not lo or lo[-1] in self.fillers) and (not hi or hi[0] in self.fillers):
                return who, len(name.split()), 0.0
        return None

    def beside(self, t: list[str]) -> Iterator[tuple[str, str]]:
        """Words beside the longest exact mention, each with the name's word on that side."""
        for _, name, lo, hi in self.mentions_in(t)[:1]:
            parts = name.split()
            for w in {*lo, *hi}:
                if w not in self.vocabulary and not w.isdigit():
                    yield w, parts[-1] if w in hi else parts[0]

    def resolve(self, value: str | None, around: bool) -> tuple[int, int, float]:
        """(indicator, words, cost) of a typed value, 0 for none. ``around``: other words may stand around the name."""
        t = words(value)
        key = f"{int(around)} {' '.join(t)}"
        hit = self.results.get(key)
        if hit is None:
            hit = self._resolve(t, around)
            if len(self.results) > 200_000:
                self.results.clear()
            self.results[key] = hit
        return hit

    def _resolve(self, t: list[str], around: bool) -> tuple[int, int, float]:
        hit = self.mention(t)
        if hit and (around or all(w in self.fillers or w in self.vocabulary for w in t)):
            # Words left over of the vocabulary may make another, longer name.
            better = self.token_set(t, around)
            return max(hit, better, key=lambda h: (h[1], -h[2]))
        hit = self.token_set(t, around)
        if not hit[0]:
            parts: list[str] = []
            for w in t:
                cut = self.split(w) if len(w) >= 4 and w not in self.vocabulary and w not in self.fillers else None
                # Few letters make words by chance, so short ones are cut between whole words only.
                if cut and len(w) < 7 and not all(len(x) > 1 and (x in self.vocabulary or x in self.fillers) for x in cut):
                    cut = None
                parts += cut or [w]
            if parts != t:
                hit = self.token_set(parts, around)
        return hit

    def token_set(self, t: list[str], around: bool) -> tuple[int, int, float]:
        """The name whose words all occur, in any order, with the fewest slips, nothing but decoration being left over."""
        read = [self.readings(w) for w in t]
        at: dict[str, list[tuple[float, int]]] = {}
        for i, options in enumerate(read):
            for w, cost in options:
                at.setdefault(w, []).append((cost, i))
        tried, best = set(), (0, 0, 0.0)
        for w in at:
            for need in self.of_word.get(w, ()):
                if need in tried or any(x not in at for x in need):
                    continue
                tried.add(need)
                who, letters = self.sets[need]
                used: dict[int, str] = {}
                total = 0.0
                for x in sorted(need, key=lambda x: (len(at[x]), min(at[x]))):
                    free = [(cost, i) for cost, i in at[x] if i not in used]
                    if not free:
                        break
                    cost, i = min(free)
                    used[i] = x
                    total += cost
                if len(used) < len(need) or total > min(MAX_COST, max(1.0, COST_PER_LETTER * letters)):
                    continue
                lo, hi = min(used) - 1, max(used) + 1
                left = [i for i in range(len(t)) if i not in used and not self.idle(t[i])]
                if any(not around or lo <= i <= hi for i in left):
                    continue
                got = (who, len(need), total)
                if (got[1], -got[2], -got[0]) > (best[1], -best[2], -best[0]):
                    best = got
        return best


_matchers: dict[str, Matcher] = {}


def matcher_of(key: str, *parts) -> Matcher:
    """The matcher of a list, made once in each worker process; only the last one used is kept."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(*parts)
    return _matchers[key]


def canonical_names(inventory: DataFrame) -> DataFrame:
    """(indicator_id, name): every name and synonym that is neither null nor blank."""
    both = F.array_append(F.coalesce("synonyms", F.array().cast("array<string>")), F.col("indicator_name"))
    return inventory.where("indicator_id is not null").select("indicator_id", F.explode(both).alias("name")).where("trim(name) <> ''").distinct()


def map_to_canonical(entries: dict[str, tuple[DataFrame, str, bool]], inventory: DataFrame, block_names: int = BLOCK_NAMES) -> DataFrame:
    """(entry_table, entry_id, typed, indicator_id): each typed value with the one indicator it names, 0 for none.

    ``entries`` maps a table's name to its rows, the column typed into, and whether other
    words may stand around the name. Null and blank values give no row; repeated rows (same
    entry_id) count once. Of equally good indicators the one with the smallest id is taken.

    Method: an automaton over all names and synonyms finds exact mentions in the value's
    words, of which the longest that don't overlap win. What remains goes to token-set
    similarity: every word of the name must occur, in any order, allowing for slips,
    plurals and abbreviations; values written without gaps are first cut by an automaton over
    all spellings one slip away. A word beside the name that is no decoration makes it
    another quantity.

    What is decoration is learned from the distinct values (:func:`learned`), as is which words
    one letter from a canonical one are words of their own: neither depends on how often a
    value or an indicator occurs. One-word names that abbreviate a longer name of
    the indicator allow no slips (:func:`acronyms`).

    Each distinct value is resolved once and joined back. The list is broadcast in blocks of
    at most ``block_names`` names, each against all values; no value is compared with the
    names one by one. An empty list maps all to 0.
    """
    typed = None
    for name, (df, column, around) in entries.items():
        part = df.select(F.lit(name).alias("entry_table"), F.col("entry_id").cast("long").alias("entry_id"), F.col(column).alias("typed"), F.lit(around).alias("around"))
        typed = part if typed is None else typed.unionByName(part)
    spark = typed.sparkSession
    # A value is blank if only white space of any kind is in it.
    typed = typed.where(F.col("typed").rlike(r"(?U)\S"))
    values = cut_lineage(typed.select("typed", "around").distinct())

    names = canonical_names(inventory)
    blocks = max(1, -(-names.count() // block_names))
    lists = []
    for b in range(blocks):
        own = names.where(F.pmod(F.xxhash64("indicator_id"), F.lit(blocks)) == b).collect()
        lists.append(spark.sparkContext.broadcast([(r[0], tuple(w)) for r in own if (w := words(r[1]))]))
    frequent, decorations = learned(values, lists)
    merged = None
    for shared in lists:
        known = spark.sparkContext.broadcast((frequent, decorations, own_words(values, shared, decorations)))

        def run(batches: Iterator[pd.DataFrame], shared=shared, known=known, key=uuid.uuid4().hex) -> Iterator[pd.DataFrame]:
            matcher = matcher_of(key, shared.value, *known.value)
            for batch in batches:
                hits = [matcher.resolve(v, a) for v, a in zip(batch["typed"], batch["around"], strict=True)]
                yield pd.DataFrame({
                    "typed": texts(batch["typed"]), "around": batch["around"].to_numpy(), "indicator_id": [h[0] for h in hits], "matched": [h[1] for h in hits], "cost": [h[2] for h in hits],
                })

        part = values.mapInPandas(run, "typed string, around boolean, indicator_id long, matched int, cost double")
        merged = part if merged is None else merged.unionByName(part)
    order = F.struct("matched", -F.col("cost"), -F.col("indicator_id"))
    if blocks > 1:
        merged = merged.groupBy("typed", "around").agg(F.max_by(F.struct("indicator_id", "matched", "cost"), order).alias("x")).select("typed", "around", "x.*")
    best = F.max_by(F.struct("typed", "indicator_id"), order)
    return typed.join(merged, ["typed", "around"]).groupBy("entry_table", "entry_id").agg(best.alias("x")).select("entry_table", "entry_id", "x.typed", "x.indicator_id")


def texts(values: Iterator[str | None]) -> pd.Series:
    return pd.Series(list(values), dtype=object)


def learned(values: DataFrame, lists: list) -> tuple[dict[str, int], frozenset]:
    """Frequent words with the number of distinct values that have them, and the words that decorate names.

    One pass over the distinct values in parallel finds the words beside exact mentions; counts
    are aggregated before and after the shuffle. What is gathered is bounded by shares of the
    values (FREQUENT, RARE).
    """
    total = values.count()
    counted = None
    for at, shared in enumerate(lists):

        def count(batches: Iterator[pd.DataFrame], shared=shared, at=at) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value)
            for batch in batches:
                out: Counter = Counter()
                for value in batch["typed"]:
                    t = words(value)
                    if not at:
                        out.update((w, None) for w in set(t))
                    out.update(matcher.beside(t))
                yield pd.DataFrame({"word": texts(k[0] for k in out), "beside": texts(k[1] for k in out), "n": list(out.values())})

        part = values.mapInPandas(count, "word string, beside string, n long")
        counted = part if counted is None else counted.unionByName(part)
    counted = counted.groupBy("word", "beside").agg(F.sum("n").alias("n"))
    by_word = counted.groupBy("word").agg(
        F.sum(F.when(F.col("beside").isNull(), F.col("n"))).alias("values"), F.coalesce(F.sum(F.when(F.col("beside").isNotNull(), F.col("n"))), F.lit(0)).alias("mentions"),
        F.count("beside").alias("spread"), F.coalesce(F.max(F.when(F.col("beside").isNotNull(), F.col("n"))), F.lit(0)).alias("most"),
    )
    enough = F.col("values") >= max(2.0, FREQUENT * total)
    decorates = (F.col("mentions") >= max(SPREAD_VALUES, RARE * total)) & (F.col("spread") >= SPREAD_WORDS) & (F.col("most") <= SPREAD_SHARE * F.col("mentions"))
    found = by_word.where(enough | decorates).select("word", "values", enough.alias("frequent"), decorates.alias("decorates")).collect()
    return {r[0]: r[1] for r in found if r[2]}, frozenset(r[0] for r in found if r[3])


def own_words(values: DataFrame, shared, decorations: frozenset) -> frozenset:
    """Words one letter from a canonical one that are too frequent to be its slips.

    A slip that puts one other letter makes each of 25 x letters forms of a word equally
    often; the rate of one form is estimated from all forms of all words, and a form that
    many times more values have is a word of its own. Only such forms are gathered: at most
    25 x letters for each word of the list, however many values there are.
    """
    known = values.sparkSession.sparkContext.broadcast(decorations)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value, decorations=known.value)
        seen: dict[str, list[str]] = {}
        for batch in batches:
            out: Counter = Counter()
            for value in batch["typed"]:
                for t in set(words(value)):
                    if t in matcher.plain:
                        out[t, None] += 1
                        continue
                    if t not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen[t] = matcher.swapped_letter(t) if t.isalpha() else []
                    for w in seen[t]:
                        out[t, w] += 1
            yield pd.DataFrame({"word": texts(k[0] for k in out), "near": texts(k[1] for k in out), "n": list(out.values())})

    rows = values.mapInPandas(near, "word string, near string, n long").groupBy("word", "near").agg(F.sum("n").alias("n")).collect()
    times = {r[0]: r[2] for r in rows if r[1] is None}
    forms = [(r[0], r[1], r[2]) for r in rows if r[1] is not None]
    places = sum(n * 25 * len(w) for w, n in times.items())

    def beyond(n: int, w: str, rate: float) -> bool:
        return n >= OWN_VALUES + OWN_TIMES * rate * times.get(w, 0)

    rate = 0.0
    for turn in range(3):  # forms found to be words don't count as slips
        rate = sum(n for _, w, n in forms if not turn or not beyond(n, w, rate)) / max(places, 1)
    found: dict[str, bool] = {}
    for t, w, n in forms:
        found[t] = found.get(t, True) and beyond(n, w, rate)
    return frozenset(t for t, own in found.items() if own)


def unmatched(mapped: DataFrame) -> DataFrame:
    """(entry_table, typed, entries): typed values that name nothing, white space and case aside, with the number of entries."""
    spelled = F.lower(F.trim(F.regexp_replace("typed", r"(?U)\s+", " ")))
    return mapped.where("indicator_id = 0").groupBy("entry_table", spelled.alias("typed")).agg(F.count("*").alias("entries"))
