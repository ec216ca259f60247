"""Problem 5: template residue, filler, error pages and notices instead of content.

Weak labels come from response-status lines and set phrases. A regularised linear classifier is trained on them with
hashed word n-grams of the text outside code, of the title, and length features; it is validated on hosts it has not
seen. Every row is scored: at ``HIGH`` and above the score decides, below ``LOW`` as well; between them it is unsure, and
the line, placeholder or filler itself is looked for.

Null and blank contents are no cases. Text in code blocks and inline code is not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import host
from sparkloom.llm import linear, sampling
from sparkloom.llm.neardup import WORD, mix, word_hashes

#: Features, rows trained on at most, and the two bars. A row over HIGH needs no evidence.
DIM, TRAIN_ROWS, LOW, HIGH = 1 << 16, 12_000, 0.02, 0.9

_FENCE = re.compile(r"^[ \t]*(?:```[^`\n]*|~~~[ \t]*[\w+#.-]*[ \t\r]*)(?:\n|\Z)", re.M)
_INLINE = re.compile(r"`[^`\n]*(?:\n(?![ \t\r]*\n)[^`\n]*){0,2}`|``.{1,200}?``")
#: Unfilled placeholders (fixed values: the template languages' forms).
PLACEHOLDER = re.compile(
    r"(?=[@{$#%<\[_])(?:@@[a-z_]{3,60}@@|(?<![\w{$#])\{[a-z]+(?:_[a-z]+)+\}(?!\})|\{\{[-#^/!&>%]?\s*[\w.| -]{1,60}\s*\}\}|\{%-?\s*\w[^%\n]{0,60}%\}|[$#]\{[\w. -]{1,60}\}|\[\[\s*[A-Z][A-Z0-9_ ]+\s*\]\]|(?<![\w])__[A-Z][A-Z0-9_]+__(?!\w)|(?<![\w%])%[A-Z][A-Z0-9_]{2,}%(?!\w)|"
    r"<%=?\s*[\w.]+\s*%>|<\s*(?:INSERT|ENTER|ADD|YOUR)\b[^<>\n]{0,60}>|\[\s*(?:INSERT|ENTER|Insert|Enter)\b[^\]\n]{1,60}\](?!\()|\[\s*(?:Your|YOUR|your)\b[^\]\n]{1,60}(?:[Hh]ere|HERE)\s*\])"
)
_MAYBE = re.compile(r"[{\[<%]|__|@@")
#: Words of the usual dummy text (fixed values).
DUMMY = set(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum augue vitae odio massa justo urna nibh sapien mauris lacus turpis ligula risus metus nunc porta purus tellus felis quam arcu "
    "donec nec vel at orci ac ante pellentesque habitant morbi tristique senectus netus malesuada fames egestas vestibulum tortor feugiat ultricies eget libero semper aenean leo pede cras "
    "dapibus vivamus elementum aliquam viverra nam tincidunt curabitur ullamcorper nullam phasellus rutrum imperdiet faucibus sem sodales sagittis".split()
)
_DUMMY_MARK = re.compile("lorem|ipsum|massa|purus|tellus|lacus", re.I)
#: Lines that stand for text nobody wrote (fixed values).
UNWRITTEN = re.compile(
    r"^\W*(?:tbd|tba|todo\b.{0,60}|fixme\b.{0,60}|coming soon|(?:xxx ?)+fill me in(?: ?xxx)*|fill me in|add your (?:text|content) .{0,40}|insert (?:the )?(?:description|text|content|title)\b.{0,40}here|"
    r"this is (?:a )?(?:placeholder|dummy|sample|filler) text\b.{0,60}|(?:your )?(?:text|content) goes here|write (?:something|this section|your text)\b.{0,30}|to be (?:written|done|completed|added)|under construction|"
    r"this (?:page|section) is (?:under construction|intentionally left blank|a stub|not written yet|empty)|placeholder|dummy text|\[?(?:content|description|text) (?:missing|pending)\]?)\W*$",
    re.I,
)
#: Lines of error pages, notices and checks (fixed values).
ERROR = re.compile(
    r"^\W*(?:(?:http|error|err|fehler|erreur|status|code)?\W{0,3}(?:40[0-9]|410|418|429|451|50[0-9]|52[0-9])\b(?:\W{1,4}(?:[\w']+ ?){0,4})?|(?:40[0-9]|410|429|50[0-9]) ?[|:–-] .{0,90}|"
    r"(?:the )?page (?:was )?not found|not found|forbidden|unauthorized|bad (?:request|gateway)|gateway time-?out|internal server error|service (?:temporarily )?unavailable|too many requests|gone|"
    r"page introuvable|seite nicht gefunden|p[áa]gina no encontrada|ページが見つかりません.{0,20}|access denied|permission denied|something went wrong|an? (?:unexpected |unknown )?error (?:has )?occurred|application error|"
    r"oops.{0,60}|sorry, (?:nothing|we|this|the page).{0,60}|we could not find (?:that|this|the) page|(?:this|that|the) page (?:is gone|does not exist|has moved|could not be found|cannot be displayed|can't be found)|"
    r"you do not have permission.{0,60}|(?:login|log in|sign in) (?:is )?required.{0,60}|you (?:must|need to) (?:log|sign) in.{0,50}|your (?:ip )?address \S+ was blocked.{0,60}|"
    r"the requested (?:address|url|page|resource).{0,80}|la direcci[óo]n solicitada.{0,50}|die angeforderte adresse.{0,50}|l'adresse demand[ée]e.{0,50}|"
    r"(?:php )?(?:fatal error|parse error|warning|notice|uncaught \w+): .{3,160}|(?:stack ?trace|traceback)\b.{0,40}|#\d+ \{main\}.{0,60}|"
    r".{0,60}\b(?:is )?(?:down|closed|offline|unavailable) for (?:scheduled )?maintenance.{0,60}|we expect to be back.{0,80}|(?:we'?ll|we will) be back.{0,60}|"
    r"checking your browser.{0,60}|one moment, verifying.{0,60}|verifying (?:you are|that you are|your).{0,60}|(?:please )?confirm (?:that )?you are (?:not a robot|human).{0,40}|"
    r"ray(?: id:?)? [0-9a-f]{6,}|reference: [0-9a-f]{6,}|incident \d+)\W*$",
    re.I,
)
#: Notices that scripts (or cookies) are needed (fixed values).
_WANTS = r"(?:java ?script|js|(?:client-side )?scripts|scripting)"
SCRIPT = re.compile(
    rf"(?:\b(?:enable|turn on|switch on|allow|activate|activer|aktivieren|activez|active|habilite|habilita)\b[^.\n]{{0,30}}\b{_WANTS}\b|\b{_WANTS}\b[^.\n]{{0,40}}\b(?:is|may be|must be|needs to be|are|has been|seems to be)?\s*(?:required|disabled|switched off|turned off|"
    rf"blocked|enabled|needed|off|aktivieren)\b|\b(?:requires?|needs?|without)\b[^.\n]{{0,20}}\b{_WANTS}\b|<noscript>)",
    re.I,
)
SHORT_CHARS, LONG_LINE_WORDS = 900, 16


def outside_code(text: str) -> str:
    """The text without code blocks and inline code. A fence that is never closed is left out alone, not what follows it."""
    if "`" not in text and "~~~" not in text:
        return text
    marks = list(_FENCE.finditer(text))
    if marks:
        parts, at = [], 0
        for k in range(0, len(marks), 2):
            parts.append(text[at : marks[k].start()])
            at = marks[min(k + 1, len(marks) - 1)].end()
        parts.append(text[at:])
        text = "\n".join(parts)
    return _INLINE.sub(" ", text) if "`" in text else text


def evidence(text: str | None) -> str | None:
    """What shows that a text is residue: placeholder, dummy, unwritten, error or script; None if nothing does."""
    if not text or not text.strip():
        return None
    own = outside_code(text)
    if _MAYBE.search(own) and PLACEHOLDER.search(own):
        return "placeholder"
    if _DUMMY_MARK.search(own):
        for line in own.lower().split("\n"):
            words = WORD.findall(line)
            if len(words) >= 4 and sum(w in DUMMY for w in words) >= 0.7 * len(words):
                return "dummy"
    lines = [" ".join(x.split()) for x in own.split("\n")]
    lines = [x for x in lines if x]
    for line in lines:
        if len(line) < 90 and UNWRITTEN.match(line):
            return "unwritten"
    if sum(x.count(" ") >= LONG_LINE_WORDS - 1 for x in lines) > 4:
        return None
    prose = [x for x in lines if not _SITE_LINE(x)]
    if sum(map(len, prose)) > SHORT_CHARS or sum(len(x.split()) >= LONG_LINE_WORDS for x in prose) > 1:
        return None
    if any(ERROR.match(x) for x in prose):
        return "error"
    if any(len(x.split()) <= LONG_LINE_WORDS and SCRIPT.search(x) for x in prose) and sum(map(len, prose)) < 400:
        return "script"
    return None


def _SITE_LINE(line: str) -> bool:  # noqa: N802
    from sparkloom.llm.layout import BOXES, site_form

    folded = re.sub("[0-9]+", "0", line.lower())
    return folded.strip("# ") in BOXES or site_form(folded)


def is_residue(text: str | None, known: object = None) -> bool:
    """The evidence alone, for operators that need to leave such rows as they are."""
    return evidence(text) is not None


_MARK = np.array([0x5BD1E9955BD1E995], np.uint64)


_SHORT = re.compile(r"^[ \t]*(\S[^\n]{0,70}?)[ \t\r]*$", re.M)


def features(text: str) -> np.ndarray:
    """Feature numbers of a text outside code: hashed words, word pairs, short lines, words of the title, and its length.

    A placeholder is a word of its own, with several numbers: a single one decides over a long text.
    """
    own = outside_code(text)
    held = _MAYBE.search(own) is not None
    own, n = PLACEHOLDER.subn(" qqplaceholderqq ", own) if held else (own, 0)
    words = word_hashes(own)
    title = word_hashes(own.strip().split("\n", 1)[0][:200])
    fixed = [1000 + int(np.log2(len(own) + 1)), 1100 + min(40, len(words) // 8), 1200 + min(20, own.count("\n"))] + ([1300 + k for k in range(24)] if n else [])
    fixed += [xxhash.xxh64_intdigest(re.sub("[0-9]+", "0", x.lower())) for x in _SHORT.findall(own)]
    pairs = words[:-1] * np.uint64(3) + words[1:]
    raw = np.concatenate([words, mix(pairs), title ^ _MARK, np.array(fixed, np.uint64)])
    return np.unique((raw % np.uint64(DIM)).astype(np.int32))


def train(df: DataFrame, text: str = "content", url: str = "url") -> tuple[np.ndarray, float, dict[str, float]]:
    """Weights, bias and the measures on unseen hosts (a fifth of them), against the weak labels.

    Trained on about ``TRAIN_ROWS`` distinct texts, chosen by their hash where they are; only features and labels come
    to the driver.
    """

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": [int(evidence(t) is not None) for t in b["_text"]], "x": [features(t) for t in b["_text"]], "held": b["_held"], "h": b["_h"]}).drop_duplicates("h")

    held = F.pmod(F.xxhash64(F.coalesce(host(F.col(url)), F.lit(""))), F.lit(5)) == 0
    rows = df.filter(F.length(F.trim(F.col(text))) > 0).select(F.col(text).alias("_text"), held.alias("_held"))
    picked = sampling.by_hash(rows, F.col("_text"), TRAIN_ROWS)
    made = picked.withColumn("_h", F.xxhash64("_text")).mapInPandas(examples, "y int, x array<int>, held boolean, h long")
    # Copies of a text count once, however many there are, and the order is that of the hashes.
    seen = made.groupBy("h").agg(F.first("y").alias("y"), F.first("x").alias("x"), F.max("held").alias("held")).toPandas().sort_values("h")
    if not len(seen):
        return np.zeros(DIM), -30.0, {"precision": 1.0, "recall": 1.0, "f1": 1.0}
    own, rest = seen[~seen["held"]], seen[seen["held"]]
    w, b = linear.fit(list(own["x"]), own["y"].to_numpy(), DIM) if len(own) and own["y"].any() else (np.zeros(DIM), -30.0)
    said = np.array([linear.probability(x, w, b) >= 0.5 for x in rest["x"]], bool)
    return w, b, linear.measures(rest["y"].to_numpy(bool), said)


def validation(df: DataFrame, text: str = "content", url: str = "url") -> DataFrame:
    """``precision, recall, f1`` of the classifier alone, at 0.5, against the weak labels of hosts that it has not seen."""
    _, _, found = train(df, text, url)
    return df.sparkSession.createDataFrame([tuple(float(found[k]) for k in ("precision", "recall", "f1"))], "precision double, recall double, f1 double")


def find_residue(df: DataFrame, key: str = "id", text: str = "content", url: str = "url") -> DataFrame:
    """``key, score, evidence`` of the rows to be dropped."""
    kind = dict(df.dtypes)[key]
    w, b, _ = train(df, text, url)
    model = df.sparkSession.sparkContext.broadcast((w.astype(np.float32), b))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = model.value
        for batch in batches:
            out = []
            for k, t in zip(batch["_key"], batch["_text"]):
                p = linear.probability(features(t), weights, bias)
                if p < LOW:
                    continue
                why = evidence(t)
                if why is not None or p >= HIGH:
                    out.append((k, p, why))
            yield pd.DataFrame(out, columns=[key, "score", "evidence"]).astype({"evidence": "object"})

    rows = df.filter(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInPandas(judge, f"{key} {kind}, score double, evidence string").groupBy(key).agg(F.max("score").alias("score"), F.max("evidence").alias("evidence"))
