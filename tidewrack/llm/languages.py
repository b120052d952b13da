"""Problem 1: the language of each document and of each passage in another language, with a confidence.

Words (runs of characters in scripts without spaces) are labelled by a linear-chain conditional random field. Emission features are affixes,
character n-grams, script and membership in lexicons of each language's own frequent words; transitions are learned, apart for
gaps within a sentence and between sentences. Forward-backward runs over whole batches of texts at once, and the posteriors of a
sentence's words make its language and confidence.

Training: labels of a bounded sample are taken as given at first, a word model drops sentences whose label it contradicts, and the field is fitted to
the rest, joined to code-switched texts. ``SAMPLE`` rows at most are read, chosen by a hash of their id.

Defined results: null, empty and blank texts, and texts without a letter, have no language; names, single words, addresses and slots are not
passages; repeated rows are labelled alike; an empty sample gives a model that knows scripts only.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import residue
from tidewrack.llm.common import HAN, KANA, LANGS, PLACEHOLDER, THAI, chosen, map_rows, nfkc, per_partition

SAMPLE = 6_000
BITS, EPOCHS = 16, 3
#: Letters (Thai, Chinese, Japanese) or words (others) from which a sentence can stand as a passage of its own; mean posterior it needs.
LEAST = {"t": 12, "c": 7, "w": 4}
SURE = 0.7

# Names and codes of the languages, in lower case, without region.
NAMES = {
    "en": "en eng english anglais inglés englisch อังกฤษ ภาษาอังกฤษ 英语 英文 英語 tiếng_anh",
    "th": "th tha thai thaï tailandés thailändisch ไทย ภาษาไทย 泰语 タイ語 tiếng_thái",
    "de": "de deu ger german deutsch allemand alemán เยอรมัน ภาษาเยอรมัน 德语 ドイツ語 tiếng_đức",
    "fr": "fr fra fre french français francais französisch francés ฝรั่งเศส ภาษาฝรั่งเศส 法语 フランス語 tiếng_pháp",
    "es": "es spa spanish español espanol castellano espagnol spanisch สเปน ภาษาสเปน 西班牙语 スペイン語 tiếng_tây_ban_nha",
    "zh": "zh zho chi cmn cn chinese mandarin chinois chinesisch chino 中文 汉语 漢語 普通话 国语 简体中文 จีน ภาษาจีน 中国語 tiếng_trung",
    "ja": "ja jpn jp japanese japonais japanisch japonés 日本語 日语 日文 ญี่ปุ่น ภาษาญี่ปุ่น tiếng_nhật",
    "vi": "vi vie vn vietnamese vietnamien vietnamesisch vietnamita tiếng_việt việt เวียดนาม ภาษาเวียดนาม 越南语 ベトナム語",
}
_LANG_OF = {name.replace("_", " "): lang for lang, names in NAMES.items() for name in names.split()}

_UNIT = re.compile(rf"(?:https?://|www\.)\S+|\S+@\S+|[{THAI}]+|[{HAN}{KANA}ー々]+|[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BREAK = re.compile(r"\n|(?<=[.!?…])[\"”’»“)\]]*\s+|(?<=[。！？])[”」』）\"]*")


def named_language(label: str | None) -> str | None:
    """The language that a label names: a code with or without region, or the language's name in one of the eight languages."""
    if not label:
        return None
    low = nfkc(label).strip().lower()
    return _LANG_OF.get(low) or _LANG_OF.get(re.split(r"[-_.;,(/ ]", low)[0])


def kind(unit: str) -> str:
    c = unit[0]
    return "t" if "฀" <= c <= "๿" else "c" if c >= "぀" and re.match(rf"[{HAN}{KANA}]", c) else "w"


def unit_features(unit: str, lexicon: dict[str, str]) -> list[int]:
    """Hashed features of a word or run."""
    k = kind(unit)
    if k == "w":
        w = unit.lower()
        p = f"^{w}$"
        out = [f"w{w}", f"a{p[:3]}", f"a{p[:4]}", f"z{p[-3:]}", f"z{p[-4:]}", f"z{p[-5:]}", *(f"3{p[i : i + 3]}" for i in range(len(p) - 2)), *(f"1{c}" for c in set(w) if c > "z")]
        if unit[:1].isupper():
            out.append("upper")
        if w in lexicon:
            out.append(f"lex{lexicon[w]}")
    elif k == "t":
        out = ["thai"]
    else:
        kana = re.search(rf"[{KANA}]", unit) is not None
        out = ["kana" if kana else "han", *(f"2{unit[i : i + 2]}" for i in range(len(unit) - 1)), *(f"1{c}" for c in set(unit))]
        if kana:
            out += ["kana2", "kana3"]
    mask = (1 << BITS) - 1
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & mask for f in dict.fromkeys(out)]


def units(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """The units of a text, the number of units in each sentence that has any, and these sentences' spans."""
    words: list[str] = []
    counts: list[int] = []
    spans: list[tuple[int, int]] = []
    addresses = "http" in text or "www." in text or "@" in text
    at = 0
    for m in [*_BREAK.finditer(text), None]:
        end, stop = (m.start(), m.end()) if m else (len(text), len(text))
        own = _UNIT.findall(text, at, end)
        if addresses:
            own = [w for w in own if w[:4] not in ("http", "www.") and "@" not in w]
        if own:
            words += own
            counts.append(len(own))
            piece = text[at:stop]
            spans.append((stop - len(piece.lstrip()), at + len(piece.rstrip())))
        at = stop
    return words, counts, spans


#: What the script alone tells: Thai is written in Thai letters only, Chinese and Japanese share the third kind of units.
_DENSE_LANGS = np.array([x in ("zh", "ja") for x in LANGS])
_THAI_ONLY = np.array([8.0 if x == "th" else -8.0 for x in LANGS], np.float32)


class LanguageField:
    """The conditional random field."""

    L = len(LANGS)

    def __init__(self) -> None:
        self.w = np.zeros((1 << BITS, self.L), np.float32)
        stay = np.full((self.L, self.L), -4.0, np.float32)
        np.fill_diagonal(stay, 0.0)
        self.a = np.stack([stay * 1.5, stay * 0.5])  # transitions within a sentence, and between sentences
        self.start = np.zeros(self.L, np.float32)
        self.lexicon: dict[str, str] = {}
        self._set_scripts()

    def _set_scripts(self) -> None:
        for name, langs in (("thai", ["th"]), ("kana", ["ja"]), ("kana2", ["ja"]), ("kana3", ["ja"]), ("han", ["zh", "ja"])):
            h = zlib.crc32(name.encode()) & ((1 << BITS) - 1)
            self.w[h] = -3.0
            for lang in langs:
                self.w[h, LANGS.index(lang)] = 3.0

    def emissions(self, unit: str) -> np.ndarray:
        k = kind(unit)
        if k == "t":
            return _THAI_ONLY
        e = np.clip(self.w[unit_features(unit, self.lexicon)].sum(0), -8, 8)
        return np.where((_DENSE_LANGS == (k == "c")) & (_THAI_ONLY < 0), e, -8.0).astype(np.float32)

    def forward_backward(self, e: np.ndarray, gap: np.ndarray, mask: np.ndarray):
        """Posteriors ``(B, T, L)``, and the scaled messages; ``gap[b, t]`` is 1 where a sentence ends before ``t``."""
        B, T, L = e.shape
        ex = np.exp(e - e.max(2, keepdims=True))
        A = np.exp(self.a)
        f = np.empty((B, T, L), np.float32)
        f[:, 0] = ex[:, 0] * np.exp(self.start)
        f[:, 0] /= f[:, 0].sum(1, keepdims=True)
        for t in range(1, T):
            p = f[:, t - 1]
            step = np.where(gap[:, t, None] == 1, p @ A[1], p @ A[0]) * ex[:, t]
            step /= step.sum(1, keepdims=True)
            f[:, t] = np.where(mask[:, t, None], step, p)
        b = np.empty_like(f)
        b[:, -1] = 1.0
        for t in range(T - 2, -1, -1):
            m = ex[:, t + 1] * b[:, t + 1]
            step = np.where(gap[:, t + 1, None] == 1, m @ A[1].T, m @ A[0].T)
            step /= step.sum(1, keepdims=True)
            b[:, t] = np.where(mask[:, t + 1, None], step, 1.0)
        post = f * b
        post /= post.sum(2, keepdims=True)
        return post, f, b, ex, A

    def fit(self, texts: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 5) -> LanguageField:
        """Fits the field to ``(text, language as labelled)``."""
        rnd = random.Random(seed)
        sents: list[tuple[list[str], str]] = []
        for text, lang in texts:
            words, counts, _ = units(text)
            at = 0
            for n in counts:
                ws, at = words[at : at + n], at + n
                if n > 1 or kind(ws[0]) != "w":
                    sents.append((ws, lang))
        if not sents:
            return self
        # a word model on the labels as they are, then without the sentences it contradicts
        for _ in range(2):
            counts: dict[str, Counter] = {x: Counter() for x in LANGS}
            for ws, lang in sents:
                counts[lang].update({f"{kind(w)}{w.lower()[-4:]}" for w in ws} | {w.lower()[:5] for w in ws} | ({c for w in ws for c in w} if kind(ws[0]) == "c" else set()))
            size = {x: sum(c.values()) + 1.0 for x, c in counts.items()}
            kept = []
            for ws, lang in sents:
                feats = {f"{kind(w)}{w.lower()[-4:]}" for w in ws} | {w.lower()[:5] for w in ws} | ({c for w in ws for c in w} if kind(ws[0]) == "c" else set())
                score = {x: sum(np.log((counts[x][f] + 0.1) / (size[x] + 100.0)) for f in feats) + 0.0 for x in LANGS}
                best = max(score, key=score.get)
                rest = max(v for x, v in score.items() if x != best)
                if score[best] - rest > 2.0:
                    kept.append((ws, best))
            sents = kept
        of: dict[str, Counter] = {x: Counter() for x in LANGS}
        for ws, lang in sents:
            of[lang].update(w.lower() for w in ws if kind(w) == "w" and w.islower())
        total = Counter()
        for c in of.values():
            total.update(c)
        self.lexicon = {w: x for x, c in of.items() for w, n in c.most_common(150) if n > 3 and n > 0.8 * total[w]}

        by_lang: dict[str, list[list[str]]] = defaultdict(list)
        for ws, lang in sents:
            by_lang[lang].append(ws)
        langs = [x for x in LANGS if by_lang[x]]
        cache: dict[str, np.ndarray] = {}

        def feats(w: str) -> np.ndarray:
            got = cache.get(w)
            if got is None:
                got = cache[w] = np.array(unit_features(w, self.lexicon), np.int64)
            return got

        gain, gain_a, gain_s = np.full(self.w.shape, 1e-2, np.float32), np.full(self.a.shape, 1e-1, np.float32), np.full(self.L, 1e-1, np.float32)
        n_batches = max(8, min(120, len(sents) // 60))
        for _ in range(epochs * n_batches):
            seqs = []
            for _ in range(48):
                x = rnd.choice(langs)
                parts = [(rnd.choice(by_lang[x]), x) for _ in range(rnd.randint(1, 3))]
                if rnd.random() < 0.4:
                    y = rnd.choice(langs)
                    parts.insert(rnd.randint(0, len(parts)), (rnd.choice(by_lang[y]), y))
                elif rnd.random() < 0.3 and len(langs) > 1:
                    # a name or two words from elsewhere within a sentence keep the sentence's label
                    ws, _ = parts[0]
                    other = rnd.choice(by_lang[rnd.choice(langs)])
                    k = rnd.randint(0, len(ws))
                    parts[0] = ([*ws[:k], *[w for w in other if w[:1].isupper()][:2], *ws[k:]], x)
                seqs.append(parts)
            T = max(sum(len(ws) for ws, _ in p) for p in seqs)
            B = len(seqs)
            e, gap, mask, gold = np.zeros((B, T, self.L), np.float32), np.zeros((B, T), np.int8), np.zeros((B, T), bool), np.zeros((B, T), np.int64)
            rows, owner = [], []
            for b, parts in enumerate(seqs):
                t = 0
                for ws, lang in parts:
                    for k, w in enumerate(ws):
                        f = feats(w)
                        e[b, t] = self.w[f].sum(0)
                        rows.append(f)
                        owner.append(np.full(len(f), b * T + t))
                        gap[b, t], mask[b, t], gold[b, t] = (1 if k == 0 and t else 0), True, LANGS.index(lang)
                        t += 1
            post, f, bk, ex, A = self.forward_backward(np.clip(e, -12, 12), gap, mask)
            g = post.copy()
            g[np.arange(B)[:, None], np.arange(T)[None], gold] -= 1.0
            g *= mask[:, :, None]
            flat = g.reshape(B * T, self.L)
            idx, own = np.concatenate(rows), np.concatenate(owner)
            u, inv = np.unique(idx, return_inverse=True)
            grad = np.stack([np.bincount(inv, flat[own, k], len(u)) for k in range(self.L)], 1).astype(np.float32) / B + 2e-5 * self.w[u]
            gain[u] += grad * grad
            self.w[u] -= 0.25 * grad / np.sqrt(gain[u])
            gs = g[:, 0].sum(0) / B + 1e-3 * self.start
            gain_s += gs * gs
            self.start -= 0.15 * gs / np.sqrt(gain_s)
            # transitions: expected minus observed counts of each kind of gap
            ga = np.zeros_like(self.a)
            for t in range(1, T):
                for kindof in (0, 1):
                    at = mask[:, t] & (gap[:, t] == kindof)
                    if at.any():
                        joint = f[at, t - 1][:, :, None] * A[kindof][None] * (ex[at, t] * bk[at, t])[:, None, :]
                        joint /= joint.sum((1, 2), keepdims=True)
                        ga[kindof] += joint.sum(0)
                        np.add.at(ga[kindof], (gold[at, t - 1], gold[at, t]), -1.0)
            ga = ga / B + 1e-3 * self.a
            gain_a += ga * ga
            self.a -= 0.15 * ga / np.sqrt(gain_a)
        return self


class Tagger:
    """Labels batches of texts; keeps the emissions, scripts and lengths of the units it has met."""

    HOLD = 150_000

    def __init__(self, field: LanguageField) -> None:
        self.field = field
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, LanguageField.L), np.float32)
        self.kinds, self.sizes = np.zeros(1024, np.int8), np.zeros(1024, np.int32)

    def _id(self, w: str) -> int:
        k = self.ids.get(w)
        if k is None:
            k = self.ids[w] = len(self.ids) + 1
            if k >= len(self.table):
                self.table, self.kinds, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.kinds, self.sizes))
            self.table[k] = self.field.emissions(w)
            self.kinds[k], self.sizes[k] = "wtc".index(kind(w)), len(w)
        return k

    def sentences(self, texts: list[str]) -> list[list[tuple[int, int, str, float, str, int]]]:
        """For each text its sentences by script: start, end, language, confidence, script and weight (words or letters)."""
        if len(self.ids) > self.HOLD:
            self._reset()
        parsed = [units(t) for t in texts]
        known, new = self.ids, self._id
        ids = [np.array([known.get(w) or new(w) for w in p[0]], np.int64) for p in parsed]
        lengths = np.array([len(x) for x in ids], np.int64)
        offset = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([np.empty(0, np.int64), *ids])
        per_seg = np.array([n for p in parsed for n in p[1]], np.int64)
        seg = np.repeat(np.arange(len(per_seg)), per_seg)
        first = np.zeros(len(flat), np.int8)
        first[1:] = seg[1:] != seg[:-1]
        post = np.empty((len(flat), LanguageField.L), np.float32)

        order = np.argsort(lengths, kind="stable")
        i = int(np.searchsorted(lengths[order], 1))
        while i < len(order):
            j = i + 1
            while j < len(order) and lengths[order[j]] <= lengths[order[i]] * 1.3 + 4 and (j - i) * lengths[order[j]] < 60_000:
                j += 1
            own = order[i:j]
            i, T = j, int(lengths[own[-1]])
            mask = np.arange(T)[None] < lengths[own][:, None]
            at = np.where(mask, offset[own][:, None] + np.arange(T)[None], 0)
            mat = np.where(mask, flat[at], 0)
            got = self.field.forward_backward(self.table[mat], np.where(mask, first[at], 0), mask)[0]
            post[at[mask]] = got[mask]

        # sums by sentence and script
        kinds, sizes = self.kinds[flat], self.sizes[flat]
        key, size = seg * 3 + kinds, np.minimum(sizes, 12).astype(np.float64)
        n = 3 * len(per_seg)
        total, weight = np.bincount(key, size, n), np.bincount(key, np.where(kinds == 0, 1, sizes), n)
        mean = np.stack([np.bincount(key, post[:, k] * size, n) for k in range(LanguageField.L)], 1) / np.maximum(total, 1e-9)[:, None]
        top = mean.argmax(1)
        conf = mean[np.arange(n), top] if n else np.empty(0)
        out: list[list] = []
        s = 0
        has, top, conf, weight = (total > 0).tolist(), top.tolist(), conf.tolist(), weight.astype(np.int64).tolist()
        for _, _, spans in parsed:
            rows = []
            for start, end in spans:
                for k in (3 * s, 3 * s + 1, 3 * s + 2):
                    if has[k]:
                        rows.append((start, end, LANGS[top[k]], conf[k], "wtc"[k - 3 * s], weight[k]))
                s += 1
            out.append(rows)
        return out


def languages_of(sents: list[tuple[int, int, str, float, str, int]]) -> dict[str, float]:
    """The languages of a text in which a whole sentence is written, with confidences; the weightiest one where no sentence is long enough."""
    out: dict[str, float] = {}
    for _, _, lang, conf, k, weight in sents:
        if weight >= LEAST[k] and conf >= SURE:
            out[lang] = max(out.get(lang, 0.0), conf)
    if not out and sents:
        sums: dict[str, float] = defaultdict(float)
        for _, _, lang, conf, k, weight in sents:
            sums[lang] += conf * (weight if k != "w" else 5 * weight)
        best = max(sums, key=sums.get)
        out[best] = max(c for _, _, x, c, _, _ in sents if x == best)
    return out


def sample(df: DataFrame, row_id: str, text: str, label: str, rows: int = SAMPLE) -> list[tuple[str, str]]:
    """``(text, language)`` of at most ``rows`` rows whose label names a language."""
    got = chosen(df.where(F.length(F.trim(text)) > 0), row_id, rows).select(text, label).collect()
    return [(t, lang) for t, x in got if (lang := named_language(x))]


def passages_of(sents: list[tuple[int, int, str, float, str, int]]) -> list[tuple[int, int, str, float]]:
    """``(start, end, lang, confidence)``: sentences of one language in a row are a passage.

    Segments that are too short to be told go with the rest of their sentence, else with the passage before, or the first one after; where all are
    too short, the text is one passage in its weightiest language.
    """
    sure = {start for start, _, _, _, k, weight in sents if weight >= LEAST[k]}
    if sents and not sure:
        [(lang, conf)] = languages_of(sents).items()
        return [(sents[0][0], max(end for _, end, *_ in sents), lang, conf)]
    merged: list[list] = []
    begin = None
    for start, end, lang, conf, k, weight in sents:
        if weight < LEAST[k]:
            if start not in sure:
                if merged:
                    merged[-1][1] = max(merged[-1][1], end)
                elif begin is None:
                    begin = start
        elif merged and merged[-1][2] == lang:
            n = merged[-1][4]
            merged[-1][1] = end
            merged[-1][3] = (merged[-1][3] * n + conf) / (n + 1)
            merged[-1][4] = n + 1
        else:
            merged.append([start if begin is None else begin, end, lang, conf, 1])
            begin = None
    return [tuple(x[:4]) for x in merged]


def _passages(shared):
    @per_partition
    def make():
        tagger = Tagger(shared.value)

        def batch(ids, texts):
            out: dict[str, list] = {k: [] for k in ("rec", "start_pos", "end_pos", "lang", "confidence")}
            for i, sents in zip(ids, tagger.sentences([t or "" for t in texts])):
                for passage in passages_of(sents):
                    for key, v in zip(out, (i, *passage)):
                        out[key].append(v)
            return out

        return batch

    return make


def passages(df: DataFrame, field: LanguageField, row_id: str, text: str) -> DataFrame:
    """``(<row_id>, start_pos, end_pos, lang, confidence)``: the passages of each text, each in one language."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    out = map_rows(df.select(row_id, text), _passages(shared), f"rec {dict(df.dtypes)[row_id]}, start_pos int, end_pos int, lang string, confidence double")
    return out.select(F.col("rec").alias(row_id), "start_pos", "end_pos", "lang", "confidence")


def _wrong(shared, labelled: bool):
    @per_partition
    def make():
        tagger = Tagger(shared.value)
        judge = residue.ExemplarIndex()

        def batch(ids, texts, labels):
            out: dict[str, list] = {"rec": [], "lang": [], "confidence": []}
            for i, t, label, sents in zip(ids, texts, labels, tagger.sentences([t or "" for t in texts])):
                if not sents or t == PLACEHOLDER:
                    continue
                found = languages_of(sents)
                if len(found) == 1 and (not labelled or named_language(label) in found):
                    continue
                if len(found) > 1 and judge.judge(t) == "residue":
                    continue
                for lang, conf in found.items():
                    out["rec"].append(i)
                    out["lang"].append(lang)
                    out["confidence"].append(conf)
            return out

        return batch

    return make


def mislabelled(df: DataFrame, field: LanguageField, row_id: str, text: str, label: str | None = None) -> DataFrame:
    """``(<row_id>, lang, confidence)`` of texts in several languages and, given a ``label`` column, of those whose label doesn't name their language."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    rows = df.select(row_id, text, F.col(label).alias("label") if label else F.lit(None).cast("string").alias("label"))
    out = map_rows(rows, _wrong(shared, label is not None), f"rec {dict(df.dtypes)[row_id]}, lang string, confidence double")
    return out.select(F.col("rec").alias(row_id), "lang", "confidence")
