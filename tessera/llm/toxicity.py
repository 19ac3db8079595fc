"""Toxicity by a weighted finite-state pattern grammar.

Each clause of a text becomes a string of word classes (insult, threat, target, negation, report, degree, other). Small
transducers for insults, threats, targets, negation and reported speech are composed into one deterministic transducer,
which runs over the clause and sums the weights of the matches: a clause scores for a threat to a target or an insult; a
built-in insult alone stays below the threshold, one aimed at a target reaches it, and one under a negation ("not an idiot",
"doesn't look stupid") or in reported speech ("she said that he is an idiot") scores a fraction. Threats need an intent before
the verb ("will", "going to"), unless they tell the reader to do it to themselves, and a target in the word order of their
language: after the verb (English), between intent and infinitive (German, French), and in Spanish after the verb, before the
intent or as the infinitive's ending.

A text's score is that of its highest clause, or the sum of what learned words score in all clauses, if that is more; built-in
words never add up over clauses, so a long text is judged as a short one is. It is toxic from ``threshold`` on.

The insult words are a short built-in English list and the words learned from labelled documents: at most ``fit_rows``
labelled rows (a bounded sample, chosen by a hash of the id) give the counts by label; a word joins the lexicon if a binomial
test rejects, at ``p_value``, that it is as usual in clean documents. What is counted are a word's distinct contexts (the
words around it), so that copies of one document count once. Scoring covers every document.

Edge cases: a null or empty text scores 0 and is kept; a null label or id is left out of the fit; no labels at all leave the
built-in list; repeated rows are scored one by one alike; extra columns pass through untouched in the pipeline stage.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, pieces

#: Rows of the labels that the lexicon is fitted on at most.
FIT_ROWS = 20_000
#: Score from which a document is toxic.
THRESHOLD = 1.0
#: Chance below which a word's toxic share is no accident.
P_VALUE = 1e-6
#: Lower bound of the odds of a learned word, toxic against clean, and the odds that alone make a document toxic.
MIN_ODDS, SURE_ODDS = 8.0, 100.0

INSULTS = "idiot idiots moron morons loser losers scum clown clowns trash stupid pathetic worthless disgusting imbecile imbeciles dumbass dimwit halfwit cretin vermin subhuman jerk bastard bastards filth".split()
THREATS = "kill murder destroy hurt beat strangle stab shoot smash crush punch choke slaughter torture attack killing murdering destroying hurting beating strangling stabbing shooting smashing crushing punching choking slaughtering torturing attacking".split()
#: German and French infinitives, which stand after their target; Spanish ones, and those that end in it.
THREATS_LAST = "töten umbringen ermorden verprügeln verletzen erstechen erschießen erwürgen vernichten zerstören tuer assassiner détruire frapper étrangler poignarder égorger buter écraser massacrer".split()
THREATS_ES = "matar asesinar destruir golpear estrangular apuñalar aplastar".split()
THREATS_OBJECT = [v + who for v in THREATS_ES for who in ("te", "os")]
#: The words that make a threat of a verb: a future or a will stands before it.
INTENTS = "will shall gonna going ll must should werde wirst voy vais vas".split()
#: Who is told to do it to themselves.
SELVES = "yourself yourselves".split()
TARGETS = "you your yours u he she they them him his her their we these those du dich dir ihr euch sie er tu te toi vous il elle ils elles usted ustedes ellos ellas".split()
NEGATIONS = "not never no isn aren wasn weren don doesn didn ain won wouldn couldn shouldn haven hasn hadn nicht kein keine keinen nie ne pas jamais nunca".split()
REPORTS = "said says say saying told tells wrote writes claims claimed called reported reportedly quoted sagte sagt dit disait dijo dice".split()
#: Words over which a negation or an intent holds; t is what contractions leave ("isn't").
DEGREES = "t to be been being look looks looking seem seems sound sounds feel feels a an the so such very really total complete utter ein eine un une una el la le".split()

WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"[.!?;:,\n]+")

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT, DEGREE, THREAT_LAST, THREAT_ES, THREAT_OBJECT, SELF = KINDS = range(12)
#: Weight of a match, and what is left of it under a negation, in reported speech, or with a target in its clause.
W_INSULT, W_THREAT, W_TARGET, KEEP_NEGATED, KEEP_REPORTED = 0.6, 2.0, 0.5, 0.1, 0.4


def classes(insults) -> dict[str, int]:
    """Class of each word; where lists overlap the first of insult, threats, intent, negation, report, target, degree counts."""
    out: dict[str, int] = {}
    for kind, words in ((INSULT, insults), (THREAT, THREATS), (THREAT_LAST, THREATS_LAST), (THREAT_ES, THREATS_ES), (THREAT_OBJECT, THREATS_OBJECT), (INTENT, INTENTS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (SELF, SELVES), (TARGET, TARGETS), (DEGREE, DEGREES)):
        for w in words:
            out.setdefault(w, kind)
    return out


def _component(names: dict, start, step):
    """A deterministic transducer: step(state, symbol) -> (next state, output)."""
    return names, start, step


#: The parts. Each reads word classes; its output says what holds for the word just read.
#: negation: a negation holds over degree words up to the next other word, so it must stand right before what it negates.
_NEG = _component({0: "plain", 1: "negated"}, 0, lambda s, c: (1 if c == NEGATION or (s and c == DEGREE) else 0, s))
#: report: after a verb of saying the rest of the clause is reported.
_REP = _component({0: "direct", 1: "reported"}, 0, lambda s, c: (1 if s or c == REPORT else 0, s))
#: target: a person was named before in the clause.
_TGT = _component({0: "none", 1: "named"}, 0, lambda s, c: (1 if s or c in (TARGET, SELF) else 0, s))
#: threat: 1 after an intent, 2 after intent and verb; a target next completes the match. 3 after an intent and then a target,
#: 4 after a target, 5 after a target and then an intent: there an infinitive of the languages that want it completes it.
#: 6 after a verb without an intent, which "yourself" completes; 7 after a negation, behind which such a verb doesn't count.
def _threat(s: int, c: int) -> tuple[int, int]:
    if c == INTENT:
        return 5 if s == 4 else 1, 0
    if s in (1, 3, 5):
        if c in (DEGREE, TARGET, SELF):
            return s if c == DEGREE else 3, 0
        if c == THREAT or c == THREAT_ES and s == 1:
            return 2, 0
        if c == THREAT_OBJECT or c == THREAT_LAST and s == 3 or c == THREAT_ES:
            return 0, 1
    if s in (2, 6, 7) and c == DEGREE:
        return s, 0
    if c in (TARGET, SELF):
        return 4, 1 if s == 2 or s == 6 and c == SELF else 0
    return 7 if c == NEGATION else 6 if c == THREAT and s != 7 else 0, 0


_THR = _component({0: "none", 1: "intent", 2: "verb", 3: "intent, target", 4: "target", 5: "target, intent", 6: "verb alone", 7: "negated"}, 0, _threat)
#: insult: emits at an insult word.
_INS = _component({0: "any"}, 0, lambda s, c: (0, 1 if c == INSULT else 0))


def compose() -> list[list[tuple[int, float, float]]]:
    """The product of the parts: table[state][class] = (next state, weight, scale of the word's own weight)."""
    parts = (_NEG, _REP, _TGT, _THR, _INS)
    start = tuple(p[1] for p in parts)
    number, queue, table = {start: 0}, [start], []
    while queue:
        state = queue.pop(0)
        row = []
        for c in KINDS:
            moved = [p[2](s, c) for p, s in zip(parts, state)]
            (_, negated), (_, reported), (_, named), (_, threat), (_, insult) = moved
            scale = (KEEP_NEGATED if negated else 1.0) * (KEEP_REPORTED if reported else 1.0)
            weight = (W_THREAT * threat + (W_TARGET * named if insult else 0.0)) * scale
            to = tuple(m[0] for m in moved)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append((number[to], weight, scale if insult else 0.0))
        table.append(row)
    return table


@dataclass
class Grammar:
    """The composed transducer with its lexicon; weights maps insult words to weights."""

    weights: dict[str, float]
    table: list = field(default_factory=compose)

    def __post_init__(self):
        self.kind = classes(self.weights)
        self.learned = frozenset(w for w, x in self.weights.items() if w not in INSULTS or x > W_INSULT)
        self.needed = frozenset(self.weights).union(THREATS, THREATS_LAST, THREATS_ES, THREATS_OBJECT)

    def clause(self, text: str) -> tuple[float, float]:
        """Score of a clause, and what of it is due to learned words."""
        state, score, learned = 0, 0.0, 0.0
        for w in WORD.findall(text):
            c = self.kind.get(w, OTHER)
            state, weight, scale = self.table[state][c]
            weight += scale * self.weights[w] if scale else 0.0
            score += weight
            if w in self.learned:
                learned += weight
        return score, learned

    def score(self, text: str | None) -> tuple[float, int]:
        """Score of a whole text and the number of clauses that score. Clauses without an insult or threat word score 0."""
        if not text:
            return 0.0, 0
        text = text.lower()
        if self.needed.isdisjoint(WORD.findall(text)):
            return 0.0, 0
        found = [s for c in CLAUSE.split(text) if (s := self.clause(c))[0] > 0]
        return round(max((max(s for s, _ in found), sum(n for _, n in found))), 6) if found else 0.0, len(found)


def labelled(labels: DataFrame, docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """toxic and text of the documents of at most fit_rows labelled rows; an id with several labels is toxic if one is."""
    sample = (
        labels.where("doc_id is not null and toxic is not null")
        .select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id", "toxic")
        .limit(fit_rows)
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    # the sample has at most fit_rows rows of two numbers, so its size is bounded whatever the input
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "id").select("toxic", "text")


def word_counts(sample: DataFrame) -> DataFrame:
    """Documents of the sample by label that hold each word: word, toxic, clean. The word of one null character counts all."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))
    return (
        sample.select("toxic", F.explode(F.array_append(words, F.lit("\0"))).alias("word"))
        .where("word <> ''")
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    )


def contexts(sample: DataFrame, words) -> DataFrame:
    """Distinct contexts by label of the given words: word, toxic, clean. A context is the words before and after."""
    wanted = frozenset(words)

    def run(batches):
        for b in pieces(batches, 1):
            found = set()
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                said = ["", *WORD.findall(text.lower()), ""]
                found.update((w, f"{said[k - 1]} {said[k + 1]}", toxic) for k, w in enumerate(said) if w in wanted)
            w, c, t = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(c, pa.string()), pa.array(t, pa.int32())], names=["word", "context", "toxic"])

    return sample.select("toxic", "text").mapInArrow(run, "word string, context string, toxic int").distinct().groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def tail(k: int, n: int, p: float) -> float:
    """Upper bound (Chernoff) of the chance of k or more of n at rate p."""
    if k <= n * p:
        return 1.0
    q = k / n
    d = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return math.exp(-n * d)


def learned(k: int, m: int, toxic: int, clean: int) -> float:
    """Weight of a word with k toxic and m clean contexts in a sample of so many toxic and clean documents; 0 if it isn't learned."""
    odds = ((k + 0.5) / (toxic + 1)) / ((m + 0.5) / (clean + 1))
    if odds < MIN_ODDS or tail(k, k + m, toxic / (toxic + clean)) > P_VALUE:
        return 0.0
    return round(min(2.0, math.log(odds) / math.log(SURE_ODDS)), 4)


def fit(labels: DataFrame, docs: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """The grammar with the built-in insults at weight ``W_INSULT`` and the learned ones at a weight that follows their log odds."""
    weights = {w: W_INSULT for w in INSULTS}
    sample = checkpoint(labelled(labels, docs, fit_rows))
    # words of the sample that lean to toxic, so bounded by fit_rows
    rows = word_counts(sample).where("word = '\0' or toxic >= 3 and toxic > clean").collect()
    total = next((r for r in rows if r.word == "\0"), None)
    if total and total.toxic and total.clean:
        for r in contexts(sample, [r.word for r in rows if len(r.word) >= 3]).collect():
            if w := learned(r.toxic, r.clean, total.toxic, total.clean):
                weights[r.word] = max(weights.get(r.word, 0.0), w)
    return Grammar(weights)


def score_documents(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, clauses (that score) and toxic for every row of docs."""

    def run(batches):
        for b in pieces(batches, 1):
            texts = b.column(1).to_pylist()
            found = [grammar.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32()), pa.array([s >= threshold for s, _ in found], pa.bool_())],
                names=["doc_id", "score", "clauses", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, clauses int, toxic boolean")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for b in pieces(batches, at):
            yield b.filter(pa.array([grammar.score(t)[0] < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
