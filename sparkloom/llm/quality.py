"""Problem 7: text statistics per document, and what they say: prose, list, table or junk.

Statistics are taken from the page's own text (see :mod:`layout`), without code. They are standardized over all rows,
and a Gaussian mixture with diagonal covariances is fitted by expectation-maximization over all rows: each round is one
pass that sums responsibilities per partition, so only (components x statistics) sums come to the driver. Components
are named after inspected examples: the class whose examples a component takes most of, or, if it takes none, the class
of the nearest example. A row belongs to the class with the largest sum of its components' shares.

Null contents have null statistics and no class; blank ones have zero words and no class. Error and filler pages
(see :mod:`residue`) have statistics but are reported by no class query.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import layout, residue
from sparkloom.session import cut_lineage

#: Words that are common in prose, by language: en, de, fr, es, it, pt (fixed values).
COMMON = set(
    "the of and to a in is it that for on with as are was be by or from at this which you can not have has will its if when than then their but an "
    "der die das und ist nicht ein eine zu den mit von für auf sich des dem im wird auch wenn als oder kann sie "
    "le la les des est une un et du pour que dans qui sur pas au avec ne ce sont ou plus par "
    "el los las una uno y es para no con por del se al lo como más pero sus hay "
    "il lo gli della di che non per sono con una os as da do em não para uma com".split()
)
STATS = ["log_words", "word_length", "symbol_ratio", "ended_lines", "common_share", "digit_ratio", "item_share", "line_words", "vowel_ratio", "variety", "sentence_share", "odd_ratio"]
COMPONENTS, ROUNDS = 22, 14
CLASSES = ["prose", "list", "table", "junk"]
_WORD = re.compile(r"[^\W_]+")
_JOIN = re.compile(r"\n(?![ \t\r]*(?:\n|[-*+•][ \t]|\d{1,3}[.)][ \t]|\||#|=|$))")
_CUT = re.compile(r"(?<=[.!?…])[\"')\]*_]*\s+|(?<=[。！？])|\n")
_ITEM = re.compile(r"^[ \t]*(?:[-*+•][ \t]|\d{1,3}[.)][ \t])", re.M)
_ENDED = re.compile(r"[.!?…:;。！？][\"')\]*_]*[ \t\r]*$", re.M)
_VOWELS, _LATIN_MORE = set("aeiouyáéíóúàèìòùâêîôûäëïöüAEIOUYÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ"), set("áéíóúàèìòùâêîôûäëïöüñçßÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÑÇ")
#: Characters that text decoded with the wrong table is full of (fixed values).
_ODD = set("�¿Œœƒ™€†‡ˆ‰") | {chr(c) for c in range(0x80, 0xA0)}
_BITS = (np.arange(64)[:, None] >> np.arange(6)) & 1
LETTER, DIGIT, SYMBOL, VOWEL, LATIN, ODD = (1 << i for i in range(6))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each character of the basic plane is, as bits."""
    out = np.zeros(65536, np.uint8)
    for c in range(65536):
        x = chr(c)
        ascii_letter = x.isascii() and x.isalpha()
        out[c] = (
            LETTER * x.isalpha() + DIGIT * x.isdigit() + SYMBOL * (not (x.isalnum() or x.isspace())) + VOWEL * (x in _VOWELS) + LATIN * (ascii_letter or x in _LATIN_MORE) + ODD * (x in _ODD)
        )
    return out


def _counts(text: str) -> list[int]:
    """How many letters, digits, symbols, vowels, Latin letters and odd characters a text has."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_kinds()[np.minimum(codes, 65535)], minlength=64)
    return (kinds @ _BITS).tolist()


def sentence_share(text: str, strict: bool = True) -> float:
    """The share of a text's characters that stands in sentences: ended, of at least four words (or eight characters without spaces), mostly letters (if ``strict``)."""
    total = max(1, len(" ".join(text.split())))
    held = 0
    for piece in _CUT.split(_JOIN.sub(" ", text)):
        piece = piece.strip()
        last = piece.rstrip("\"')]*_`")[-1:]
        if last in ("。", "！", "？"):
            held += len(piece) if len(piece) >= 8 else 0
        elif last in (".", "!", "?", "…") and piece.count(" ") >= 3 and piece[0] not in "#|" and (not strict or sum(map(str.isalpha, piece)) >= 0.6 * len(piece)):
            held += len(piece)
    return held / total


def statistics(body: str) -> list[float]:
    """The values of STATS for a page's own text."""
    text = residue.outside_code(body)
    words = _WORD.findall(text.lower())
    n, chars = len(words), max(1, len(text) - text.count(" ") - text.count("\n"))
    lines = max(1, sum(1 for x in text.split("\n") if x and not x.isspace()))
    _, digits, symbols, vowels, latin, odd = _counts(text)
    return [
        float(np.log1p(n)), min(30.0, sum(map(len, words)) / max(1, n)), symbols / chars, len(_ENDED.findall(text)) / lines,
        sum(map(COMMON.__contains__, words)) / max(1, n), digits / chars, len(_ITEM.findall(text)) / lines, min(60.0, n / lines),
        vowels / latin if latin else 0.4, len(set(words)) / max(1, n), sentence_share(text, symbols + digits > 0.15 * chars), odd / chars,
    ]


#: Inspected examples, invented after rows that were read (class, text).
EXAMPLES = [
    ("prose", "The cache keeps every session until it expires. When the limit is reached, the oldest entry is removed first, and a warning is written to the log.\n\nYou can change the limit in the settings."),
    ("prose", "# Why the export waits\n\nA job that starts while another one is running has to wait. This is not an error; it will be resumed as soon as the queue is empty."),
    ("prose", "Le serveur garde chaque session dans la mémoire. Pour la vider, ouvrez la console et lancez la commande."),
    ("prose", "Der Dienst speichert jede Sitzung im Speicher. Wenn die Grenze erreicht ist, wird der älteste Eintrag entfernt."),
    ("prose", "# 設定の確認\n\nこの画面は十分ごとに記録を更新します。まず設定を確認し、次に通知を公開します。古い項目は、移動したあとも残ります。"),
    ("prose", "# Options\n\nThe tool reads a file and writes a report. These are the steps:\n- Open the file with the editor.\n- Keep the default values unless you need others.\n\nIt is safe to repeat them."),
    ("list", "# All partners\n\n- [Bovo](https://bovo.example/a)\n- [Kusi](https://kusi.example/b)\n- [Lepa](https://lepa.example/c)\n- [Rudo](https://rudo.example/d)\n- [Tami](https://tami.example/e)"),
    ("list", "Meda Koro\nPilu Sena\nGaro Fimi\nBese Tolu\nNira Vako\nHodu Pele\nSimo Rafa\nCuka Dive"),
    ("list", "Index of names\n\nalpha, 12\nbridge, 40\ncable, 77\ndriver, 103\nengine, 180\nfilter, 212"),
    ("list", "* red button\n* daily report\n* cold store\n* large window\n* quiet folder\n* new ledger\n* plain scope"),
    ("table", "id,name,kind,size\n1042,red,widget,12.5\n2231,blue,panel,3.9\n887,green,button,40.1\n16,white,panel,8.8\n5120,black,widget,77.0"),
    ("table", "| name | size | kind |\n|---|---|---|\n| alpha | 120 | small |\n| bravo | 9931 | large |\n| delta | 77 | small |"),
    ("table", "alpha_report\t12.401\t77.200\t3.118\nbeta_window\t9.002\t13.700\t44.010\ngamma_list\t61.090\t8.114\t20.500"),
    ("table", "queue_size.................   512   rows\nretry_limit................   12    times\nopen_files.................   2048  files"),
    ("junk", '{"panel":12931,"color":"red","limit":99120,"name":"blue","queue":23011,"kind":"large","depth":7,"mode":"cold"}'),
    ("junk", "2024-02-03T10:11:12Z ERROR queue_size code=71 took=120ms\n2024-02-03T10:11:19Z WARN open_files code=3 took=8120ms\n2024-02-04T01:00:01Z DEBUG retry code=0 took=4ms"),
    ("junk", "4f 09 a2 77 1b c0 de 33 91 0a ff 28 6c 12 e4 5d\n08 bb 71 2e 90 44 fa 03 d7 66 19 cc 50 8e 3a f1"),
    ("junk", "Qm9vayBvZiBub2lzZQ8Xwe4aW1TygASbgedOutKKpaOowhJHPg1k4oeRXNOChm1z\nkWmVKeVEBa9XJwgIEz3WXP6CY820jdZgnBgWYDNwDYo5LoE700MLh9WadcXFuP7e"),
    ("junk", "@@##!! %%%% ^^~~ ;;;; <<>> ::// ++==\n$$%% &&&& ***? ||\\\\ ~~~~ !!!! ^^ @@@ ##"),
    ("junk", "xkcdrw plmntr bvgtz qwrtps dfghj zxcvb\nnmklp wrtps ghjkl bvcxz tgbyh"),
    ("junk", "menu shop price menu cheap shop buy price menu shop online price buy cheap menu shop price online buy menu shop"),
    ("junk", "Ã¼â€™Å“ Ã¡i ¿½ Âeƒâ€œ ™aÃ¤ oÅ¡ ½Âu¡ €œ ÃÅo â¼"),
]


def row_statistics(df: DataFrame, key: str = "id", source: str = "source_id", text: str = "content", residue_too: bool = True) -> DataFrame:
    """``key, residue, stats`` of every row with text that is not blank. ``residue`` is looked for where there is no prose."""
    kind = dict(df.dtypes)[key]
    rows = df.filter(F.length(F.regexp_replace(F.col(text), r"\s", "")) > 0).select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    rows, known_of = layout.with_known(rows, "_source", "_text")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, bad = [], []
            for t, known in zip(batch["_text"], known_of(batch)):
                body = layout.body_of(t, layout.label(t, known))
                stats = statistics(body)
                bad.append(residue_too and stats[10] < 0.5 and residue.is_residue(t, known))
                out.append(stats)
            yield pd.DataFrame({key: batch["_key"], "residue": bad, "stats": out})

    return rows.drop("_source").mapInPandas(measure, f"{key} {kind}, residue boolean, stats array<double>")


class Mixture:
    """A Gaussian mixture on standardized statistics, and the class of each component."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.shift, self.scale, self.weight, self.mean, self.var = shift, scale, weight, mean, var
        self.owner = np.zeros(len(weight), int)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.shift) / self.scale, -6, 6)

    def shares(self, z: np.ndarray) -> np.ndarray:
        log = np.log(self.weight) - 0.5 * (np.log(2 * np.pi * self.var).sum(1) + (((z[:, None, :] - self.mean) ** 2) / self.var).sum(2))
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def name(self, examples: list[tuple[str, str]] = EXAMPLES) -> None:
        """Gives every component the class of the examples it takes, or of the nearest one."""
        z = self.standard(np.array([statistics(t) for _, t in examples]))
        own = np.array([CLASSES.index(c) for c, _ in examples])
        share = self.shares(z)
        for k in range(len(self.weight)):
            votes = np.bincount(own, share[:, k] / np.bincount(own, minlength=len(CLASSES))[own], len(CLASSES))
            near = ((z - self.mean[k]) ** 2 / np.maximum(self.var[k], 0.25)).sum(1)
            self.owner[k] = votes.argmax() if votes.max() >= 0.1 else own[near.argmin()]

    def classes(self, x: np.ndarray) -> np.ndarray:
        share = self.shares(self.standard(x))
        return np.stack([share[:, self.owner == c].sum(1) for c in range(len(CLASSES))], 1)


def fit(stats: DataFrame, components: int = COMPONENTS, rounds: int = ROUNDS) -> Mixture:
    """The mixture over all rows of ``stats``. A component starts at an inspected example far from those before it."""
    d = len(STATS)
    sums = stats.select(*[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]).first()
    shift = np.array([sums[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.maximum(np.array([sums[f"s{i}"] or 0.0 for i in range(d)]), 1e-3)
    z = np.clip((np.array([statistics(t) for _, t in EXAMPLES]) - shift) / scale, -6, 6)
    chosen = [0]
    while len(chosen) < min(components, len(z)):
        away = np.min([((z - z[c]) ** 2).sum(1) for c in chosen], 0)
        chosen.append(int(away.argmax()))
    model = Mixture(shift, scale, np.full(len(chosen), 1 / len(chosen)), z[chosen].copy(), np.ones((len(chosen), d)))
    sc = stats.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast((model.shift, model.scale, model.weight, model.mean, model.var))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = Mixture(*shared.value)
            n, s, q = 0.0, 0.0, 0.0
            for batch in batches:
                if len(batch):
                    x = own.standard(np.stack(batch["stats"].to_numpy()))
                    r = own.shares(x)
                    n, s, q = n + r.sum(0), s + r.T @ x, q + r.T @ (x * x)
            if isinstance(n, np.ndarray):
                yield pd.DataFrame({"k": range(len(n)), "n": n, "s": list(s), "q": list(q)})

        parts = stats.select("stats").mapInPandas(expect, "k int, n double, s array<double>, q array<double>")
        totals = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d)], *[F.sum(F.col("q")[i]).alias(f"q{i}") for i in range(d)]).orderBy("k").collect()
        shared.unpersist()
        if not totals:
            break
        n = np.array([r["n"] for r in totals])
        mean = np.array([[r[f"s{i}"] for i in range(d)] for r in totals]) / np.maximum(n, 1e-9)[:, None]
        var = np.array([[r[f"q{i}"] for i in range(d)] for r in totals]) / np.maximum(n, 1e-9)[:, None] - mean**2
        kept = n > 1e-3
        step = float(np.abs(mean - model.mean)[kept].max()) if kept.any() else 0.0
        model = Mixture(shift, scale, np.maximum(n, 1e-6) / n.sum(), np.where(kept[:, None], mean, model.mean), np.where(kept[:, None], np.maximum(var, 0.01), model.var))
        if step < 0.005:
            break
    model.name()
    return model


def classify(df: DataFrame, key: str = "id", source: str = "source_id", text: str = "content") -> DataFrame:
    """``key, residue, class, share`` and the statistics of every row with text that is not blank."""
    stats = cut_lineage(row_statistics(df, key, source, text))
    model = fit(stats)
    shared = stats.sparkSession.sparkContext.broadcast((model.shift, model.scale, model.weight, model.mean, model.var, model.owner))

    @F.pandas_udf("class string, share double")
    def judge(values: pd.Series) -> pd.DataFrame:
        *parts, owner = shared.value
        own = Mixture(*parts)
        own.owner = owner
        p = own.classes(np.stack(values.to_numpy())) if len(values) else np.zeros((0, len(CLASSES)))
        return pd.DataFrame({"class": [CLASSES[i] for i in p.argmax(1)], "share": p.max(1) if len(p) else []})

    out = stats.withColumn("_c", judge("stats"))
    return out.select(key, "residue", "_c.class", "_c.share", *[F.col("stats")[i].alias(n) for i, n in enumerate(STATS)])


def find_not_prose(df: DataFrame, key: str = "id", source: str = "source_id", text: str = "content") -> DataFrame:
    """``key`` of the rows whose main body is a list, table or junk. Checked last: hardly any of it stands in sentences."""
    rows = classify(df, key, source, text)
    return rows.filter((F.col("class") != "prose") & ~F.col("residue") & (F.col("sentence_share") < 0.25)).select(key).distinct()


def source_words(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_id, n_rows, words, stated, difference``: word counts added up per source beside the stated total.

    Null source ids form one row; sources without pages have zero words. Null contents count as a row without words.
    """
    counted = pages.select("source_id", F.coalesce(F.regexp_count(F.lower("content"), F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).alias("_w"))
    own = counted.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_w").alias("words"))
    stated = sources.groupBy("source_id").agg(F.max("total_word_count").alias("stated")).withColumnRenamed("source_id", "_sid")
    both = own.join(stated, F.col("source_id").eqNullSafe(F.col("_sid")), "full")
    words = F.coalesce("words", F.lit(0)).cast("long")
    return both.select(F.coalesce("source_id", "_sid").alias("source_id"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), words.alias("words"), F.col("stated").cast("long").alias("stated"), (words - F.col("stated")).alias("difference"))
