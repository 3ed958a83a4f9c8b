"""Secret scans: patterns for known kinds, and character Markov models for the rest.

Operator 8.  Two first-order models over character classes' letters, one of random strings and
one of ordinary names, words and numbers, are trained from labelled samples; a part of a run
is a secret when the log-likelihood ratios of its pairs of characters sum to more than a threshold,
so a short one needs a higher mean than a long one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of secrets in the order that breaks ties, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so the least length may stand in the pattern
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Size of each class of the labelled sample.
SAMPLE = 4000
#: Characters that join pieces of a run.
JOINTS = "/_-=+"
#: Mean ratio of a pair, and pairs of that mean, whose sum a random string must exceed whatever its length.
THRESHOLD, EVIDENCE = 0.75, 18
#: Fall of the sum inside a segment from which on it is two, with ordinary pieces between.
DROP = 8.0
#: Characters of a piece that goes with a random one beside it.
SHORT = 3
#: Greatest ratio of one pair, so that no two or three rare pairs decide.
MOST = 4.5
#: Ratio that stands between runs of the alphabet's characters.
GAP = -1e5

#: Parts of ordinary identifiers for the labelled sample.
PARTS = (
    "get set is has to from make build read write load save open close start stop begin end next last first user "
    "name value index count total size length width height file path line text word page item list map table row "
    "column key node edge graph tree root leaf parent child image pixel label region shape point vector matrix "
    "error warning message event handler listener manager factory service client server request response session "
    "token password secret config option setting default current previous temporary internal external public "
    "private static final abstract interface implementation version update delete insert select create remove "
    "the and that with for tion ing ere ent est ver der und ein che sch lich keit ung que les eau eux ment ción ado"
).split()

#: Words of ordinary names and prose in four languages, besides.
WORDS = (
    "about above account across action active address after again against agree allow almost along already also although always "
    "among amount another answer apply argument around array article available average backup balance before behind believe better "
    "between binary block body border bottom boundary branch browser buffer build business callback cancel capital category center "
    "century certain change channel character check child choose city class clear client clock cloud collect color command comment "
    "common community company compare complete condition connect consider contact contain content context continue control convert "
    "country course cover current customer daily data database date debug decimal decode default degree delta depth describe "
    "design detail develop device dictionary different digital direct directory display distance document domain double download "
    "drive dynamic economy education effect effort either element email enable encode energy engine english enough ensure "
    "environment equal escape every exact example except execute exist expect explain export express extra factor false family "
    "fatal feature field figure filter final finance float follow force foreign format forward found frame front function future "
    "general global government group growth half handle hash health heavy help high history hold home hour house however human "
    "identity image import include increase industry input inside install instance integer interest interval issue join journal "
    "justice keyword kind know known label language large later launch layer layout learn length level library light limit linux "
    "listen little local locale lock login logic long loop lower machine mailbox main major make manage manual market mask match "
    "material maximum measure media medium member memory merge metadata method middle minimum minute mission mobile mode model "
    "modern module money month more mount move multiple music mutex native nature near network never night normal north nothing "
    "notice null number object offset option order origin other output outside owner package parallel param parse partition "
    "password patch pattern people percent perform permission person picture pipe place plain platform player policy pool popular "
    "port position possible power prefix prepare present press price primary print problem process product profile program project "
    "property protocol provide proxy public purpose push python quality query question queue quick quote random range rate reach "
    "ready reason receive recent record reduce refer reflect register regular relation release remote repeat replace report "
    "require research reserve reset resolve resource rest restore result return review right road role round route rule safe same "
    "sample scale scan schedule schema school science scope screen script search season second section security segment self send "
    "sense sequence serial series set several shape share shell short should show signal similar simple single site skip small "
    "social socket software source south space special specific speed split stack stage standard state static station status step "
    "stop store stream street string strong structure student study style submit subject success suffix suggest summer support "
    "surface switch symbol symlink syntax system table target task team template term test their theme there thing think thread "
    "three through throw ticket time timeout title today together toggle topic total touch track trade traffic train transfer "
    "transform travel trigger true trust tuple turn type under undo union unique unit unknown unpack until update upload upper "
    "usage utility valid variable various vector vendor verbose version video view village virtual visible visit volume wait walk "
    "want warning watch water weather week weight welcome west whether which while white wide widget width will window winter with "
    "within without woman wonder word work world would wrap write xml year yellow yes young zero zip zone zoom http https www com "
    "org net html json yaml utf iso ascii tmp usr lib bin etc var opt abc xyz max min str int bool len idx num obj ptr src dst fmt "
    "msg err cfg env ctx req res args kwargs init exec sync async auth admin uuid aber allein alles andere arbeit auch aufgabe "
    "beispiel bereits besonders bild bis damit deutsch durch einfach entwicklung erste etwas frage frau ganz gegen gemeinde "
    "geschichte gesellschaft gesetz gibt grund haben hatte heute ihre immer jahr jetzt kann kein kinder kommen konnte land leben "
    "letzte liegt mann mehr mensch muss nach nicht noch oder politik recht regierung schule schon sehr sein seit selbst sich sind "
    "sollte sprache stadt stark steht teil tag unter verein verschiedene viel vom von vor wasser weg weil weiter welt wenn werden "
    "wichtig wieder wird wirtschaft wissenschaft wohl zeit zum zur zusammen zwischen zwei platz satz schutz nutzung setzen kurz "
    "aussi autre avant avec avoir beaucoup bien bonjour cela cette chez chose comme contre dans depuis dernier deux donc elle "
    "encore enfant entre faire femme fois homme jamais jour leur lieu mais moins monde notre nous nouveau ouvrage parce pays "
    "pendant peut plus pour pouvoir premier quand quelque rien sans sera seulement sont sous suivant toujours tous tout travail "
    "vers veux vie ville voir vous jeux beau mieux heureux travaux maison raison aider aimer ailleurs ahora algunos antes aunque "
    "cada casa casi como cuando cuatro desde donde durante ella entonces equipo esta este forma gobierno gracias gran grande hacer "
    "hasta hijo historia hombre hoy juego lugar luego mayor mejor menos mismo momento mucho mujer mundo muy nada nombre nosotros "
    "nuestro nueva obra otro para parte pero persona poder porque primera pueblo puede quien segundo siempre sobre tambien tanto "
    "tiempo tiene todo trabajo tres vez vida zona azul raza paz luz voz "
    "kopf topf kampf opfer dampf pflicht pflanze pferd pflegen empfehlen schimpfen netz jetzt setzt trotz nutzen schatz spitze katze "
    "hex base sock type skip buf wrx dtd xhtml ipv mbox tmpdir mkdir chmod sys proc"
).split()


def labelled_sample(size: int = SAMPLE, seed: int = 20):
    """(random strings, ordinary identifiers), made by a seeded generator; ``size`` of each."""
    rng = np.random.default_rng(seed)
    sets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62], "0123456789abcdef", ALPHABET)
    strings = ["".join(rng.choice(list(sets[k % len(sets)]), rng.integers(20, 64))) for k in range(size)]
    parts = [p for p in dict.fromkeys([*PARTS, *WORDS]) if p.isascii()]
    plain = []
    for k in range(size):
        chosen = [str(p) for p in rng.choice(parts, rng.integers(3, 8))]
        style = k % 5
        if style == 0:
            word = "_".join(chosen)
        elif style == 1:
            word = chosen[0] + "".join(p.title() for p in chosen[1:])
        elif style == 2:
            word = "-".join(chosen) + "-" * int(rng.integers(0, 20))
        elif style == 3:
            word = "/".join(chosen) + ("/" + str(rng.integers(1, 3000)) if rng.random() < 0.5 else "")
        else:
            word = "".join(chosen)
        plain.append(word.upper() if rng.random() < 0.15 else word)
    for _ in range(size // 4):
        a, b, c, d = (int(x) for x in rng.integers(0, 10 ** rng.integers(1, 10, 4)))
        one, two = (str(p) for p in rng.choice(parts, 2))
        plain += [
            f"{a % 30 + 1995}-{b % 12 + 1:02}-{c % 28 + 1:02}T{d % 24:02}", f"{b % 28 + 1}/{c % 12 + 1}/{a % 30 + 1995}", f"+{a % 99}-{b % 999}-{c}", f"{a}_{b}_{c}",
            f"{one}{a % 100}", f"{one}{a % 100}_{two}{b % 10}", f"{one}={b}", f"{one}={two}", f"{c}-{d}",
        ]
    plain += ["=" * 30, "-" * 40, "_" * 30, "-=" * 20, "/" * 25] * max(1, size // 100)
    return strings, plain


def _codes() -> np.ndarray:
    """The number of each character; those outside the alphabet have the last one."""
    codes = np.full(129, len(ALPHABET), np.int64)
    for k, c in enumerate(ALPHABET):
        codes[ord(c)] = k
    return codes


def trained(strings: list[str], plain: list[str], weight: float = 20.0) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters: random against ordinary.

    Pairs are smoothed by the shares of their second characters, which count as ``weight`` pairs.
    """
    codes, n = _codes(), len(ALPHABET)

    def model(sample: list[str]) -> np.ndarray:
        counts = np.zeros((n, n))
        for s in sample:
            c = codes[np.frombuffer(s.encode("ascii"), np.uint8)]
            np.add.at(counts, (c[:-1], c[1:]), 1)
        single = (counts.sum(0) + 1) / (counts.sum() + n)
        return np.log((counts + weight * single) / (counts.sum(1, keepdims=True) + weight))

    return np.clip(model(strings) - model(plain), -MOST, MOST)


class Scanner:
    """Finds the spans of one text; holds the table of ratios, a few KB."""

    def __init__(self, ratios: np.ndarray, threshold: float = THRESHOLD) -> None:
        self.ratios, self.threshold, self.codes = ratios, threshold, _codes()
        self.least = threshold * EVIDENCE
        self.table = np.full((len(ALPHABET) + 1, len(ALPHABET) + 1), GAP)
        self.table[:-1, :-1] = ratios
        self.least = threshold * EVIDENCE
        self.table = np.full((len(ALPHABET) + 1, len(ALPHABET) + 1), GAP)
        self.table[:-1, :-1] = ratios
        self.least = threshold * EVIDENCE
        self.table = np.full((len(ALPHABET) + 1, len(ALPHABET) + 1), GAP)
        self.table[:-1, :-1] = ratios
        self.least = threshold * EVIDENCE
        self.table = np.full((len(ALPHABET) + 1, len(ALPHABET) + 1), GAP)
        self.table[:-1, :-1] = ratios

    def ratio(self, token: str) -> float:
        """Mean log-likelihood ratio of a token's pairs of characters."""
        c = self.codes[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratios[c[:-1], c[1:]].mean())

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        return found + [("hex", *m.span()) for m in HEX.finditer(text)]

    def added(self, text: str) -> list[tuple[str, int, int]]:
        """What is likelier random than ordinary by enough evidence, in runs of the alphabet's characters."""
        return [("random", a + i, a + j) for a, b in self._runs(text) for i, j in self._random(text[a:b])]

    def _sums(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the characters, and the ratios of pairs summed up to each character."""
        c = self.codes[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]
        return c, np.cumsum(np.concatenate([[0.0], self.table[c[:-1], c[1:]]]))

    def _runs(self, text: str) -> list[tuple[int, int]]:
        """The runs that may hold enough evidence; the others can't, whatever their length."""
        if len(text) < 2:
            return []
        c, sums = self._sums(text)
        hits = np.flatnonzero(sums - np.minimum.accumulate(sums) > self.least - 0.01)
        gaps = np.concatenate([[-1], np.flatnonzero(c == len(ALPHABET)), [len(c)]])
        return [(int(gaps[k - 1]) + 1, int(gaps[k])) for k in np.unique(np.searchsorted(gaps, hits))]

    def _random(self, run: str) -> list[tuple[int, int]]:
        """Segments of a run with the greatest sums, widened to the pieces that / _ - = + bound.

        An end piece of which the segment has less than half is left out; a next piece that is too
        short to be judged goes with them.
        """
        out, open_ = [], [(0, len(run))]
        while open_:
            low, high = open_.pop()
            if high - low < 2:
                continue
            sums = self._sums(run[low:high])[1]
            gains = sums - np.minimum.accumulate(sums)
            last = int(gains.argmax())
            if gains[last] <= self.least:
                continue
            first = int(sums[: last + 1].argmin())
            joints = [k for k in range(high - low) if run[low + k] in JOINTS]
            inner = sums[first : last + 1]
            falls = np.maximum.accumulate(inner) - inner
            between = [k for k in joints if first < k < last]
            if between and falls.max() > DROP:
                k = min(between, key=lambda k: abs(k - first - int(falls.argmax())))
                open_ += [(low, low + k), (low + k + 1, high)]
                continue
            starts = [0, *(k + 1 for k in joints if k + 1 < high - low)]
            ends = [*(k - 1 for k in joints if k), high - low - 1]
            k = bisect_right(starts, first) - 1
            if k + 1 < len(starts) and starts[k + 1] <= last and 2 * first > starts[k] + starts[k + 1] - 1:
                k += 1
            while k and starts[k] - starts[k - 1] - 1 <= SHORT:
                k -= 1
            first = starts[k]
            k = bisect_left(ends, last)
            if k and ends[k - 1] > first and 2 * last < ends[k - 1] + ends[k] + 1:
                k -= 1
            while k < len(ends) - 1 and ends[k + 1] - ends[k] - 1 <= SHORT:
                k += 1
            last = ends[k]
            out.append((low + first, low + last + 1))
            open_ += [(low, low + first), (low + last + 1, high)]
        return sorted(out)


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


def scanner(size: int = SAMPLE, threshold: float = THRESHOLD) -> Scanner:
    """A scanner trained on the generated sample of ``size`` strings of each label."""
    return Scanner(trained(*labelled_sample(size)), threshold)


def secret_scan(docs: DataFrame, model: Scanner | None = None) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans and all spans, one row per row of ``docs``.

    A null text is empty and has no spans; a null doc_id is carried along; texts are scanned whole
    whatever their length; repeated rows repeat; other columns are ignored.
    """
    model = model or scanner()

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text if isinstance(text, str) else ""
            base = model.base(text)
            kinds = [k for k, _, _ in base]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            extra = model.added(text)
            rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, joined(base + extra), len(extra)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select("doc_id", scan("text").alias("_s")).select("doc_id", "_s.*")


MASK = "[secret]"


def redacted(docs: DataFrame, model: Scanner | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mask``; n_chars, where present, follows.

    Spans that overlap are replaced together; texts without secrets, and nulls, stay as they are.
    """
    model = model or scanner()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if not text:
                return text
            spans = in_order(model.base(text) + model.added(text))
            out, at = [], 0
            for k, (_, a, b) in enumerate(spans):
                if a >= at or not k:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join(out) + text[at:] if spans else text

        return texts.map(one, na_action="ignore")

    done = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return done
