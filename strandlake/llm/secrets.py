"""Secret scans, in DataFrame functions only: fixed patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math
import random
from functools import cache
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import cut

#: Fixed by the contract: kinds in their order, a pattern each, and the group that counts with its least length. Runs of one class
#: are matched at their least length at once; `assign` may not be, as a match that fails still uses up its text.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the models are asked about, and the least ratio (nats) from which a string is a secret.
CANDIDATE, THRESHOLD = r"[A-Za-z0-9+/_=-]{16,}", 12.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words of which ordinary names and long words are made, by language, without accents.
NAMES = {
    "en": "account address archive balance billing buffer calendar category channel client collection command content context customer database default directory document element example filter gateway handler history identifier journal keyboard language library location notification",
    "de": "anzeige arbeit aufgabe ausgabe bericht beschreibung datei eigenschaft einstellung fehler fenster gemeinschaft geschwindigkeit gesellschaft kunde leistung nachricht rechnung schnittstelle sicherheit verbindung verwaltung wirtschaft zeichen",
    "fr": "adresse affichage bibliotheque chemin commande compte connexion demande developpement dossier enregistrement environnement fichier fournisseur gestion langue membre nouveau paiement question recherche serveur utilisateur",
    "es": "archivo ayuda busqueda caracter carpeta ciudad cliente conexion contenido cuenta desarrollo direccion empresa enlace entrada mensaje nombre numero pagina pregunta respuesta servicio trabajo usuario",
}
#: Endings that such words get, by language.
ENDINGS = {"en": ["", "s", "ing", "ation", "ness"], "de": ["", "en", "ungen", "keit", "heiten"], "fr": ["", "s", "ement", "ation", "eaux"], "es": ["", "s", "ciones", "mente", "idad"]}
#: Beginnings and ends of syllables, of which other words are made.
ONSETS = ["b", "bl", "br", "c", "ch", "d", "f", "fl", "g", "gr", "h", "l", "m", "n", "p", "pf", "qu", "r", "s", "sch", "sh", "st", "t", "th", "tr", "tz", "v", "wh", "z"]
RIMES = ["a", "an", "and", "e", "ea", "ei", "en", "er", "es", "i", "ing", "ion", "o", "or", "ou", "ly", "u", "un", "ung", "eau"]
#: Alphabets of random strings: letters and digits, base64 and its form for URLs, lower case, upper case, few letters.
RANDOM = {"alnum": ALPHABET[:62], "base64": ALPHABET[:64], "url": ALPHABET[:62] + "_-", "lower": ALPHABET[26:62], "upper": ALPHABET[:26] + ALPHABET[52:62], "hex": "0123456789ABCDEF"}


def random_string(r: random.Random, kind: str, least: int = 16, most: int = 44) -> str:
    return "".join(r.choice(RANDOM[kind]) for _ in range(r.randint(least, most)))


def ordinary_string(r: random.Random) -> str:
    """A name in one of several styles, a long word, a path, digits, or a row of one sign; not all are as long as CANDIDATE asks."""
    lang = r.choice(list(NAMES))
    word = lambda: r.choice(NAMES[lang].split()) + r.choice(ENDINGS[lang])
    syllables = lambda n: "".join(r.choice(ONSETS) + r.choice(RIMES) for _ in range(n))
    names = [word() if r.random() < 0.7 else syllables(r.randint(2, 5)) for _ in range(r.randint(2, 5))]
    digits = "".join(r.choice("0123456789") for _ in range(r.randint(1, 24)))
    date = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
    styles = [
        "_".join(names), "-".join(names), "/".join(names), "/" + "/".join(names), names[0] + "".join(x.title() for x in names[1:]), "".join(x.title() for x in names), "_".join(names).upper(), "".join(names), "".join(names).title(),
        "_".join(names) + "_" + digits[:4], names[0] + "".join(x.title() for x in names[1:]) + digits[:2], digits, digits + "-" + digits[:6], date + "-" + "-".join(names), r.choice("-=_+/") * r.randint(8, 60), "=".join(names[:2]),
    ]
    return r.choice(styles)


def labelled_samples(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1: random, 0: ordinary), n of each, drawn by rule."""
    r = random.Random(seed)
    kinds = list(RANDOM)
    return [x for k in range(n) for x in ((random_string(r, kinds[k % len(kinds)]), 1), (ordinary_string(r), 0))]


def train(samples: list[tuple[str, int]], smooth: float = 0.5) -> list[float]:
    """log P(next | character) under the random model less that under the identifier model, for all pairs of ALPHABET."""
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[smooth] * (n * n) for _ in range(2)]
    for s, y in samples:
        for a, b in pairwise(s):
            counts[y][at[a] * n + at[b]] += 1
    rows = [[sum(c[a * n : a * n + n]) for a in range(n)] for c in counts]
    return [math.log(counts[1][k] / rows[1][k // n]) - math.log(counts[0][k] / rows[0][k // n]) for k in range(n * n)]


def ratio(s: str, table: list[float]) -> float:
    """The summed log-likelihood ratio of a string."""
    at, n = {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
    return sum(table[at[a] * n + at[b]] for a, b in pairwise(s))


@cache
def models() -> tuple[list[float], float]:
    """The ratios, and the threshold: one nat above all ordinary strings of a sample that the models don't know, THRESHOLD at least."""
    table = train(labelled_samples())
    return table, max(THRESHOLD, 1 + max(ratio(s, table) for s, y in labelled_samples(6000, 8) if not y))


def log_ratio(token: Column, table: list[float]) -> Column:
    """The summed log-likelihood ratio of a string over ALPHABET, in one pass over its characters; the table is one literal."""
    ratios = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")
    place = lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, at: F.struct(at.alias("last"), (acc["sum"] + F.coalesce(F.get(ratios, acc["last"] * len(ALPHABET) + at), F.lit(0.0))).alias("sum"))
    return F.aggregate(F.transform(F.split(token, ""), place), start, step, lambda acc: acc["sum"])


def _matches(text: Column, kind: str, pattern: str, ok) -> Column:
    """kind, and per match the text before it, its length and whether it counts; only where there is a match at all."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    lens = F.transform(found, F.char_length)
    return F.when(text.rlike(pattern), F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), lens.alias("len"), ok(text, found).alias("ok")))


def scan(docs: DataFrame, table: list[float] | None = None, threshold: float | None = None) -> DataFrame:
    """doc_id and spans, an array of (start, rank, end, kind) in code points, sorted, for every row of docs.

    Kinds assign, access and hex are all leftmost non-overlapping matches of KINDS that are long enough; kind markov adds
    the strings of CANDIDATE whose ratio reaches the threshold and that touch none of those. Null and empty texts have no
    spans; a null doc_id is kept; repeated rows give repeated rows; no rows give none; other columns are ignored.
    """
    table, threshold = table or models()[0], models()[1] if threshold is None else threshold
    t = F.coalesce("text", F.lit(""))
    parts = {}
    for kind, pattern, group, least in KINDS:
        parts[kind] = _matches(t, kind, pattern, lambda x, _, p=pattern, g=group, n=least: F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(g)), lambda y: F.char_length(y) >= n))
    parts["markov"] = _matches(t, "markov", CANDIDATE, lambda _, found: F.transform(found, lambda y: log_ratio(y, table) >= threshold))
    read = cut(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), *(c.alias(k) for k, c in parts.items())))
    each = None
    for rank, kind in enumerate(parts):
        own = read.where(F.size(kind) > 0).select("row", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("j", "m"))
        each = own if each is None else each.unionByName(own)
    before = Window.partitionBy("row", "rank").orderBy("j")
    placed = each.select("row", "rank", "kind", F.col("m.ok").alias("ok"), F.col("m.len").alias("len"), (F.sum(F.col("m.gap") + F.col("m.len")).over(before) - F.col("m.len")).alias("start"))
    spans = placed.where("ok").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", (F.col("start") + F.col("len")).alias("end"), "kind"))).alias("s"))
    base = F.filter("s", lambda x: x["rank"] < len(KINDS))
    apart = F.filter("s", lambda x: (x["rank"] < len(KINDS)) | ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    return read.select("doc_id", "row").join(spans.select("row", apart.alias("spans")), "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
