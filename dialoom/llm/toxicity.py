"""Toxicity by a weighted finite-state pattern grammar.

A clause is a run of words up to a mark of punctuation or a line feed. Its words become classes (insult, threat,
target, negation, reported speech, other), which pass a cascade of transducers that is composed once into a table:

    negation   insults and threats within three words after a negation leave it as their negated forms
    reported   after a verb of saying, what follows in the clause leaves it as its reported form
    threat     a threat with a target within four words leaves it as an aimed threat
    target     an insult and a target in the same clause, in either order, add the weight of aiming

A clause's score is the weight of its path. The document's score is the sum over its matched clauses. From those that match by
stems alone an allowance is taken, as stems also occur by chance; clauses with a seed, a term or an aimed threat count in full. It is toxic from `threshold` on, so that one insult without a target isn't enough, nor are any number of negated threats.

Insults are a seed list in four languages, and terms and stems learnt from labelled documents by their likelihood ratio.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

THRESHOLD = 1.4
#: Bound on labelled documents for the fit, by class; the classifier of terms is the only thing that is fitted on a sample.
SAMPLE = {1: 6_000, 0: 18_000}
#: Nats that a term's occurrences must be worth against chance.
EVIDENCE = 20.0
#: Times as frequent that a stem must be among the words of toxic documents.
RATIO = 8.0
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
#: Weight that is taken off a document's clauses without any other match for each match of a stem that chance alone would give in its length.
ALLOWANCE = 8.0

OTHER, INSULT, THREAT, TARGET, NEGATE, REPORT = range(6)
INSULT_N, THREAT_N, INSULT_R, THREAT_R, AIMED, AIMED_N, AIMED_R = range(6, 13)

SEEDS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown bastard bastards filthy vermin imbecile retard dumbass asshole subhuman",
    "fr": "idiot idiote imbécile crétin crétine abruti abrutie débile ordure connard connasse salaud salope minable",
    "de": "idiot idioten dumm dummkopf trottel abschaum arschloch schwachkopf mistkerl widerlich erbärmlich wertlos",
    "es": "idiota idiotas imbécil estúpido estúpida basura escoria asqueroso asquerosa inútil cabrón miserable",
}
WORDS = {
    THREAT: "kill hurt destroy beat stab shoot burn strangle murder tuer frapper détruire brûler töten schlagen vernichten verletzen umbringen matar golpear destruir quemar",
    TARGET: "you your you're youre u he she they them him her these those toi tu vous te lui eux elle du dich dir ihr ihn sie euch tú te ti usted ellos ella vosotros",
    NEGATE: "not no never isn't aren't wasn't don't doesn't didn't won't nor neither without pas jamais aucun nicht kein keine keinen nie niemals nunca jamás tampoco sin",
    REPORT: "said says claimed wrote quoted called reported told alleged accused dit écrit appelé sagte schrieb nannte behauptete dijo escribió llamó",
}


class Transducer:
    """step(state, symbol) -> (state, symbol, weight), from a start state."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def _negation(s, x):
    if x == NEGATE:
        return 3, x, 0.0
    if s and x in (INSULT, THREAT):
        return s - 1, INSULT_N if x == INSULT else THREAT_N, 0.0
    return max(0, s - 1), x, 0.0


def _reported(s, x):
    if x == REPORT:
        return 1, x, 0.0
    return s, {INSULT: INSULT_R, THREAT: THREAT_R}.get(x, x) if s else x, 0.0


def _threat(s, x):
    # (words left for a target, symbol of the threat)
    left, what = s
    if x in (THREAT, THREAT_N, THREAT_R):
        return (4, {THREAT: AIMED, THREAT_N: AIMED_N, THREAT_R: AIMED_R}[x]), x, 0.0
    if x == TARGET and left:
        return (0, 0), what, 0.0
    return ((left - 1, what) if left > 1 else (0, 0)), x, 0.0


_WEIGHTS = {INSULT: 1.0, INSULT_N: 0.15, INSULT_R: 0.4, AIMED: 2.0, AIMED_N: 0.1, AIMED_R: 0.5}


def _target(s, x):
    # bit 0: a target was seen, bit 1: an insult of full weight was, 4: aiming is counted.
    w = _WEIGHTS.get(x, 0.0)
    if s == 4:
        return 4, x, w
    s |= {TARGET: 1, AIMED: 1, INSULT: 2}.get(x, 0)
    return (4, x, w + 0.75) if s == 3 else (s, x, w)


GRAMMAR = [Transducer(0, _negation), Transducer(0, _reported), Transducer((0, 0), _threat), Transducer(0, _target)]


def compose(cascade, alphabet=range(6)):
    """The cascade as one machine over the words' classes: tables of next states and weights; state 0 is the start."""
    start = tuple(t.start for t in cascade)
    number, queue, nexts, weights = {start: 0}, [start], [], []
    for state in queue:
        row, cost = [], []
        for x in alphabet:
            to, w = [], 0.0
            for t, s in zip(cascade, state):
                s, x, dw = t.step(s, x)
                to.append(s)
                w += dw
            to = tuple(to)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
            cost.append(w)
        nexts.append(row)
        weights.append(cost)
    return nexts, weights


NEXT, WEIGHT = compose(GRAMMAR)

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_CLAUSE_END = re.compile(r"[.,;:!?\n|()\"]")
_CLASSES = {w: c for c, ws in WORDS.items() for w in ws.split()}


def clause_score(clause: str, insults: dict[str, float], stems: dict[str, float]) -> tuple[float, int]:
    """Weight of the clause's path, and how many insults or threats it has; the clause is in lower case."""
    state, score, hits = 0, 0.0, 0
    for m in _TOKEN.finditer(clause):
        w = m.group().replace("’", "'")
        strength = insults.get(w)
        if strength is None and stems:
            strength = next((stems[w[:n]] for n in STEM_LENGTHS if w[:n] in stems), None)
        c = INSULT if strength is not None else _CLASSES.get(w, OTHER)
        hits += c in (INSULT, THREAT)
        score += WEIGHT[state][c] * (strength if c == INSULT else 1.0)
        state = NEXT[state][c]
    return score, hits


class Matcher:
    """Finds the clauses that hold an insult or a threat with an Aho-Corasick automaton, and scores only those."""

    def __init__(self, insults: dict[str, float], stems: dict[str, float], noise: float = 0.0):
        import ahocorasick

        self.insults, self.stems, self.noise = insults, stems, noise
        self.machine = ahocorasick.Automaton()
        for w in {*insults, *stems, *WORDS[THREAT].split()}:
            self.machine.add_word(w, len(w))
        self.machine.make_automaton()

    def score(self, text: str) -> tuple[float, int]:
        """(sum of the clauses' scores, those of stems alone less what chance allows a text of its length; number of matched clauses) of a whole text."""
        low = text.lower()
        firm, loose, matched, done = 0.0, 0.0, 0, -1
        for end, n in self.machine.iter(low):
            at = end - n + 1
            if at < done or at > 0 and low[at - 1].isalpha():
                continue
            left = at
            while left > 0 and not _CLAUSE_END.match(low[left - 1]):
                left -= 1
            right = _CLAUSE_END.search(low, end + 1)
            right = right.start() if right else len(low)
            score, hits = clause_score(low[left:right], self.insults, self.stems)
            if hits and score > 0:
                if self.noise and clause_score(low[left:right], self.insults, {})[0] == 0:
                    loose += score
                else:
                    firm += score
                matched += 1
            done = right
        return round(firm + max(0.0, loose - ALLOWANCE * self.noise * len(low)), 4), matched


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: dict | None = None, evidence: float = EVIDENCE) -> dict[str, tuple[dict, dict, float]]:
    """{language: (terms, stems, noise)} with strengths up to 1, from labelled documents.

    At most `sample[1]` toxic and `sample[0]` other labelled documents count, chosen by the hash of their id.
    Of documents that share the least hash of their word triples (copies), one counts. A term must occur in toxic
    documents so often that chance is excluded by `evidence` nats, and in next to no others. A stem, by which five or more
    words begin, must be RATIO times as frequent among the words of toxic documents; it also occurs by chance, as
    often as `noise` says: matches a character in documents that aren't toxic.
    """
    sample = sample or SAMPLE
    spark = docs.sparkSession
    mark = labels.select(F.col(id_col).cast("long").alias("i"), F.col("toxic").cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.max("y").alias("y"))
    parts = [mark.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(n) for y, n in sample.items()]
    chosen = parts[0].unionByName(parts[1])  # bounded by `sample`, so small enough to broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("t")).where("t is not null")
    ws = F.filter(F.split(F.lower("t"), r"[^\p{L}\p{M}]+"), lambda w: w != "")
    got = texts.join(F.broadcast(chosen), "i").select("lang", "y", "i", F.length("t").alias("chars"), ws.alias("ws"))
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 2, F.lit(1))), lambda k: F.xxhash64(F.slice("ws", k, 3)))
    got = got.withColumn("sig", F.array_min(triples)).groupBy("lang", "sig").agg(F.min_by(F.struct("y", "chars", "ws"), "i").alias("d")).select("lang", "d.y", "d.chars", F.array_distinct("d.ws").alias("ws"))
    got = cut(got)
    of = lambda y, x: F.coalesce(F.sum(F.when(F.col("y") == y, x)), F.lit(0))
    totals = {r["lang"]: r for r in got.groupBy("lang").agg(of(1, F.lit(1)).alias("pos"), of(0, F.lit(1)).alias("neg"), of(1, F.size("ws")).alias("pos_words"), of(0, F.size("ws")).alias("neg_words"), of(0, F.col("chars")).alias("chars")).collect()}
    out: dict[str, tuple[dict, dict, float]] = {k: ({}, {}, 0.0) for k in totals}
    if not any(r["pos"] for r in totals.values()):
        return out
    by_lang = lambda f: F.create_map(*[x for k, r in totals.items() for x in (F.lit(k), F.lit(float(f(r))))])[F.col("lang")]
    seen = cut(got.select("lang", "y", F.explode("ws").alias("w")).groupBy("lang", "w").agg(of(1, F.lit(1)).alias("pos"), of(0, F.lit(1)).alias("neg")))
    worth = by_lang(lambda r: math.log((r["pos"] + r["neg"]) / r["pos"]) if r["pos"] else 0.0)
    for r in seen.where((F.col("pos") * worth >= evidence) & (F.col("neg") <= 0.02 * F.col("pos")) & (F.length("w") > 3)).select("lang", "w").collect():
        out[r["lang"]][0][r["w"]] = 1.0
    # Stems: rates among the (distinct) words of a document, half a word added.
    lengths = F.explode(F.array(*[F.lit(n) for n in STEM_LENGTHS])).alias("n")
    heads = seen.select("lang", lengths, "w", "pos", "neg").where("length(w) >= n").groupBy("lang", F.expr("substring(w, 1, n)").alias("w"))
    stems = heads.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count_if(F.col("pos") > 0).alias("kinds")).where("kinds >= 5")
    ratio = F.col("pos") * by_lang(lambda r: r["neg_words"] + 1) / ((F.col("neg") + 0.5) * by_lang(lambda r: r["pos_words"] + 1))
    for r in stems.where((ratio >= RATIO) & (F.col("pos") * F.log(ratio) >= evidence)).select("lang", "w", "neg").orderBy(F.length("w"), "w").collect():
        terms, kept, noise = out[r["lang"]]
        if not any(r["w"].startswith(k) for k in kept):  # else a shorter stem holds it
            kept[r["w"]] = 1.0
            out[r["lang"]] = terms, kept, noise + r["neg"] / max(1, totals[r["lang"]]["chars"])
    return out


def lexicon(learnt: dict[str, tuple[dict, dict, float]] | None = None) -> dict[str, tuple[dict, dict, float]]:
    """Seeds and learnt terms by language; "" has all of them, for texts of no known language."""
    out: dict[str, tuple[dict, dict, float]] = {k: ({w: 1.0 for w in ws.split()}, {}, 0.0) for k, ws in SEEDS.items()}
    for k, (terms, stems, noise) in (learnt or {}).items():
        seeds = out.get(k, ({}, {}, 0.0))[0]
        out[k] = {**seeds, **terms}, dict(stems), noise
    every: tuple[dict, dict] = ({}, {})
    for terms, stems, _ in out.values():
        every[0].update(terms)
        every[1].update(stems)
    out[""] = *every, max(noise for _, _, noise in out.values())
    return out


def _scorer(words: dict):
    def run(batches):
        machines = {k: Matcher(*v) for k, v in words.items()}
        for b in batches:
            score, matched = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for k, (lang, text) in enumerate(zip(part.column("__lang").to_pylist(), part.column("__text").to_pylist()), at):
                    if text:
                        score[k], matched[k] = machines.get(lang, machines[""]).score(text)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(score), pa.array(matched)], names=[*b.schema.names[2:], "__score", "__matched"])

    return run


def _scored(docs: DataFrame, carry: list, labels: DataFrame | None, id_col: str, text_col: str, lang_col: str, learnt: dict | None) -> DataFrame:
    if learnt is None:
        learnt = learn(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col) if labels is not None else {}
    seen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__lang"), F.col(text_col).alias("__text"), *carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seen.schema[2:])
    return seen.mapInArrow(_scorer(lexicon(learnt)), f"{schema}, __score double, __matched int")


def toxic_documents(docs: DataFrame, labels: DataFrame | None = None, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learnt: dict | None = None) -> DataFrame:
    """(doc_id, score, clauses) of every document whose matched clauses weigh `threshold` or more in sum.

    - Null and empty texts have score 0. A null or unknown language is matched against the words of all languages.
    - Repeated rows are scored each. Without labels, or with empty ones, only the seeds count.
    - Whole texts are read, whatever their length. An empty table gives an empty result. Other columns are ignored.
    """
    got = _scored(docs, [F.col(id_col).alias("doc_id")], labels, id_col, text_col, lang_col, learnt)
    return got.where(F.col("__score") >= threshold).select("doc_id", F.col("__score").alias("score"), F.col("__matched").alias("clauses"))


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learnt: dict | None = None) -> DataFrame:
    """docs without the toxic ones; the rest as it is, with all columns. See toxic_documents."""
    inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    got = _scored(docs, inner, labels, id_col, text_col, lang_col, learnt)
    return got.where(F.col("__score") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
