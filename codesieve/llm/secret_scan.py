"""Secrets: base patterns, and strings that a character Markov model of random strings explains better than one of ordinary identifiers and prose.

Both models are trained by grouped counts of character pairs over labelled samples; a candidate that holds a letter is a secret when the log-likelihood
ratio per character exceeds a threshold. Where a whole candidate doesn't, its pieces between '-' and '_' are tried, as a key may follow a long name. The
models have at most 67 x 67 probabilities each.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import raw, ship, slices

KINDS = ("assign", "access", "hex", "random")
Span = tuple[int, int, str]
#: Characters of a candidate; in the models all others are one state, which is also what is before the first.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/-_"
OTHER = len(ALPHABET)
STATES = OTHER + 1
MIN_LENGTH = 16
THRESHOLD = 0.35
SAMPLES = 4000

_STATE = np.full(256, OTHER, np.uint8)
_STATE[list(ALPHABET.encode())] = np.arange(OTHER)
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_NAMES = (b"passw", b"secret", b"token", b"api")
# Runs are greedy in the base patterns, so those too short fail at every later start as well.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_LENGTH - 2},}}={{0,2}}")
_PARTS = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_LETTER = re.compile(r"[A-Za-z]")


def detect(text: str) -> list[Span]:
    """(start, end, kind) of the base kinds; a find is the whole match."""
    low, found = text.encode("utf-8", "surrogatepass").lower(), []
    if any(n in low for n in _NAMES):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_VERBS = "get set load save read write open close find make build parse check update create delete remove insert select format convert handle process compute render resolve register validate initialize serialize allocate download".split()
_NOUNS = "user name file path list item node value index count buffer token request response message session config option handler manager service controller factory context document window element attribute property database connection transaction repository application environment parameter configuration notification authentication".split()

#: Prose of the corpus' languages, without accents, since characters with one end a candidate.
_PROSE = tuple(
    sorted({w for w in text.split() if len(w) > 1})
    for text in (
        """the house on the hill had been empty for as long as anyone could remember and children were often told that nothing good would come from walking there after dark when spring
        arrived however the new owners opened every window cleaned the rooms and invited their neighbours to a large supper which changed what people thought about them entirely although
        information about the government decision was published yesterday several important questions concerning education public transportation and international relations remain without
        satisfactory answers because something between these different groups is missing scientists have shown through careful measurement that higher temperatures increase pressure within
        the closed system while knowledge of previous conditions helps us understand whether dangerous consequences could follow quickly possible beautiful children should thinking another
        against question enough language mother strength weather friendship happiness management development responsible understanding independent necessary throughout economic various""",
        """das alte haus am rande der stadt war schon lange nicht mehr bewohnt und niemand wusste genau warum die letzten besitzer so schnell verschwunden waren im herbst kamen jedoch neue
        nachbarn die alle zimmer reinigten und jeden sonntag ihre freunde zum essen einluden obwohl die regierung gestern eine wichtige entscheidung veroeffentlicht hat bleiben zahlreiche
        fragen ueber bildung verkehr gesundheit und wirtschaftliche zusammenarbeit ohne befriedigende antwort weil zwischen diesen verschiedenen gruppen etwas fehlt wissenschaftler haben
        durch sorgfaeltige messungen gezeigt dass hoehere temperaturen den druck innerhalb eines geschlossenen systems erhoehen moeglichkeit freiheit geschwindigkeit versicherung wohnung
        gesellschaft landschaft eigentlich natuerlich schliesslich pflanze kopf pfeffer schmutz platz schutz arbeit einigkeit beziehungen erfahrung verantwortung entwicklung bundeskanzler
        rechtsanwalt strasse zeitung maedchen sprache deutlich zurueck einfach beispiel grundsaetzlich unternehmen verhaeltnis gespraech fruehstueck krankenhaus gleichzeitig aufgabe""",
        """la vieille maison au bout du village restait vide depuis longtemps et personne ne savait vraiment pourquoi les derniers habitants avaient disparu si vite mais au printemps une
        famille nombreuse ouvrit toutes les fenetres nettoya chaque chambre et invita ses voisins pour un grand repas le gouvernement vient de publier une decision importante pourtant
        plusieurs questions concernant enseignement transports sante publique et relations internationales demeurent sans reponse satisfaisante parce que quelque chose manque entre ces
        differents groupes les chercheurs montrent par des mesures precises que la temperature augmente la pression dans un systeme ferme nouveau chateau oiseau beaucoup heureux eau yeux
        cheveux travailleur bonheur lumiere feuille bouteille mouvement developpement notamment egalement seulement aujourd hui jamais toujours lorsque quatre quinze lequel auxquelles
        connaissance entreprise environnement bibliotheque philosophie magnifique naturelle personnelle ensemble commencer choisir reussir comprendre peut etre""",
        """la casa vieja al final del pueblo llevaba mucho tiempo vacia y nadie sabia por que sus ultimos habitantes desaparecieron tan rapido sin embargo en primavera una familia numerosa
        abrio todas las ventanas limpio cada cuarto e invito a los vecinos para una gran cena el gobierno acaba de publicar una decision importante pero varias preguntas sobre educacion
        transporte salud publica y relaciones internacionales quedan sin respuesta satisfactoria porque falta algo entre esos diferentes grupos los investigadores demuestran mediante
        mediciones precisas que la temperatura aumenta la presion dentro de un sistema cerrado trabajo ciudad mujer hombre siempre tambien nosotros juego guerra cuando quien aquellos
        desarrollo conocimiento naturalmente posibilidad universidad felicidad corazon caballo llamar lluvia calle querer zapato azucar extranjero hijo izquierda derecho empresa
        bosque blanco negro agradecimiento necesidades responsables comunidades actualmente""",
    )
)

_AROUND = (("__", "__"), ("_", ""), ("--", ""), ("/", ""), ("/", "/"), ("----", "----"))


def _ordinary(words: list[str], kind: int) -> str:
    title = [w.title() for w in words]
    return ("_".join(words), words[0] + "".join(title[1:]), "".join(title), "-".join(words), "/".join(words), "".join(words), "_".join(words).upper(), "".join(words).upper())[kind]


def samples(spark: SparkSession, n: int = SAMPLES, seed: int = 7) -> DataFrame:
    """(text, label): n random strings (1) in the alphabets that keys use, and n ordinary identifiers, paths and run-on words and prose (0)."""
    r, rows = random.Random(seed), []
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:36], ALPHABET[26:62], ALPHABET[:64], ALPHABET[:52], ALPHABET[:62] + "-_", ALPHABET[:26], ALPHABET[26:52])
    for k in range(n):
        size = r.randint(16, 64)
        rows.append((base64.b64encode(r.randbytes(size)).decode() if k % 10 == 9 else "".join(r.choices(alphabets[k % 10], k=size)), 1))
        words = [r.choice(_VERBS), *r.choices(_NOUNS, k=r.randint(2, 4))] if k % 3 == 0 else r.choices(_PROSE[k % 4], k=r.randint(3, 7))
        if (u := r.random()) < 0.2:
            words.append(str(r.randint(1, 2024)))
        elif u < 0.3:
            words.insert(r.choice((0, len(words))), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}")
        before, after = r.choice(_AROUND) if r.random() < 0.2 else ("", "")
        rows.append((before + _ordinary(words, r.randrange(8)) + after, 0))
    return spark.createDataFrame(rows, "text string, label int")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros((2, STATES * STATES), np.int64)
    for part in slices(batches):
        for t, label in zip(raw(part.column("text")), part.column("label").to_pylist()):
            s = _STATE[np.frombuffer(b" " + t, np.uint8)].astype(np.int64)
            count[int(label)] += np.bincount(s[:-1] * STATES + s[1:], minlength=STATES * STATES)
    label, pair = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(count[label, pair])], names=["label", "pair", "n"])


def train(labelled: DataFrame, smooth: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each character pair, random over ordinary, from a table (text, label); rows with a null in either don't count."""
    ship(labelled.sparkSession)
    pairs = labelled.where("text IS NOT NULL AND label IN (0, 1)").select("text", "label").mapInArrow(_pairs, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    count = np.full((2, STATES, STATES), smooth)
    for r in pairs.collect():  # two matrices at most
        count[r["label"]].flat[r["pair"]] += r["n"]
    log = np.log(count / count.sum(axis=2, keepdims=True))
    return log[1] - log[0]


def ratio(model: np.ndarray, text: str) -> float:
    """Log-likelihood ratio per character."""
    s = _STATE[np.frombuffer(b" " + text.encode("utf-8", "replace"), np.uint8)]
    return float(model[s[:-1], s[1:]].sum()) / max(1, len(text))


def _random(text: str, model: np.ndarray, threshold: float) -> bool:
    """Numbers alone are no secret, whatever the models say."""
    return len(text) >= MIN_LENGTH and bool(_LETTER.search(text)) and ratio(model, text) > threshold


def spans(text: str, model: np.ndarray, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start, then kind as listed. A find of the model that shares a character with a base span isn't added."""
    if not _CANDIDATE.search(text) and not any(n in text.encode("utf-8", "surrogatepass").lower() for n in _NAMES):
        return [], []
    base, added = detect(text), []

    def free(m: re.Match) -> bool:
        return not any(m.start() < e and s < m.end() for s, e, _ in base)

    for run in _CANDIDATE.finditer(text):
        if free(run) and _random(run[0], model, threshold):
            added.append((*run.span(), "random"))
        else:
            added += [(*m.span(), "random") for m in _PARTS.finditer(text, *run.span()) if m.span() != run.span() and free(m) and _random(m[0], model, threshold)]
    return base, sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


def joined(found: list[Span]) -> str:
    return ",".join([f"{kind}:{s}:{e}" for s, e, kind in found])


_ROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_random", pa.int64()), ("n_found", pa.int64())])


def _scan(model: np.ndarray, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows = []
        for t in part.column("text").to_pylist():
            base, every = spans(t or "", model, threshold)
            rows.append((*[sum(s[2] == k for s in base) for k in KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base), len(every)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(zip(*rows), list(_ROW)[1:])]], schema=_ROW)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random, n_found) for each row of docs; labelled: the models' (text, label), else samples().

    The n_ of base kinds count base spans, n_random the model's and n_found all. A null or empty text has no span; repeated rows each get theirs; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    model = train(samples(spark) if labelled is None else labelled)
    if not math.isfinite(float(model.sum())):
        raise ValueError("the labelled samples gave no model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda b: _scan(model, threshold, b), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, n_found long")
