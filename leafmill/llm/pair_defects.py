"""Broken prompt and response pairs (problem 4).

A response is cut into clauses (sentences, as far as it has any). A conditional random field tags each clause as
answer, refusal, echo, foreign or unfinished, from what the clause is made of: scripts, words shared with the prompt,
character pairs, quotation, its place, and for the last clause how it ends. Names, numbers and glossary words are
folded to one symbol each there, so that the frame of the sentence shows; a frame that stops where whole sentences
of the corpus never stop is unfinished. The share of the characters under each tag gives the defect of the pair.

The field is fitted on a bounded sample (``SAMPLE`` responses, ``ODD`` that look odd and ``REPEATED`` that answer several
prompts, chosen by a hash). Nobody has labelled clauses, so the sample's labels come from plain rules, and unfinished
clauses are made by cutting whole ones (clauses with others behind them) at random places, with any mark behind the cut.
Refusals are known in two ways: by some wordings, and, whatever the wording, as a response of which a clause stands under
``PROMPTS`` or more different prompts and no clause says anything of theirs, no name, number or glossary word. The glossary words that
are folded are those of the sample's prompts, so they are as bounded as it is. Everything else covers all versions.

Defined results: a null or empty response is ``empty``; a response without letter, digit or Chinese character is too;
without an English text (null sha, no paragraph, or several: then the smallest) it is judged by itself; versions
delivered more than once count once (of differing deliveries each verdict has a row); a null seq has no row; very long responses are tagged whole.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.alignment import TEXT_WORDS, TOKEN, Aligner, fit_names, glossary_forms
from leafmill.llm.crf import Crf
from leafmill.llm.lookalikes import Lookalikes, Rewriter
from leafmill.operators.skew import salted_join
from leafmill.runtime import load, ship, stage

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
DEFECT = {REFUSAL: "refusal", ECHO: "copy", FOREIGN: "other_language"}
SAMPLE, ODD, REPEATED = 6000, 3000, 2000
PROMPTS = 3
HALF = 0.5

CLAUSE = re.compile(r"(?:[。！？]|……|…|[.!?]+(?=[\s”\"'）)]|$)|\n)[。！？…”）\"'）]*")
QUOTED = re.compile(r"[“\"«].*?(?:[”\"»]|$)", re.S)
HAN = re.compile("[\u3400-\u9fff\uf900-\ufaff]")
WORD = re.compile(r"[^\W\d_]+", re.U)
LATIN = re.compile(r"[a-zà-öø-ɏ]+(?:['’][a-z]+)?")
LETTER = frozenset(c for c in map(chr, range(0x250)) if re.match("[A-Za-zÀ-ɏ'’\\-]", c)) | {"’"}
END = re.compile(r"[\s。！？!?.…，,、；;：:”\"“’'）)（(\]\[—\-]*$")
OPEN_END = re.compile(r"(?:[，,、；;：:“（(\[]|—+|（未完|\[截断\]|[（\[][^）\]]{0,24})\s*$")

# Wordings by which the rules label refusals of the sample.
REFUSALS = re.compile(
    r"(?:无法|不能|不便|没有办法|没办法|难以|恕难|恕不|拒绝|未能|不予).{0,12}(?:翻译|译出|译文|处理|提供|协助|生成|完成|给出|回答|中文)"
    r"|作为.{0,6}(?:AI|人工智能|语言模型|助手)|请求.{0,6}超出|超出.{0,8}(?:协助|能力)|版权.{0,8}(?:不能|无法)|请换一段|请见谅|请谅解|很遗憾|非常抱歉|^对不起|^抱歉"
    r"|(?:unable|cannot|can't|can’t|won't|won’t|not able|decline|afraid|not something).*(?:translat|render|comply|help|assist|process|provid|passage|request|paragraph|text)"
    r"|as an? (?:ai\b|assistant|language model)|under the current guidelines|supply another passage|^(?:i'm |i’m |i am )?sorry\b|at this time\W*$",
    re.I,
)
#: Marks that may stand behind a break, for the clauses that are cut to fit the field.
BREAKS = (*("", "……", "...", "、", "，", "“", "（未完", " [截断]") * 4, "——", "；", "。")


def clauses(text: str) -> list[str]:
    out, at = [], 0
    for m in CLAUSE.finditer(text):
        if WORD.search(text, at, m.end()) or re.search(r"\d", text[at : m.end()]):
            out.append(text[at : m.end()])
            at = m.end()
    rest = text[at:]
    if rest.strip():
        if out and not (WORD.search(rest) or re.search(r"\d", rest)):
            out[-1] += rest
        else:
            out.append(rest)
    return out


def letters_of(clause: str) -> str:
    return "".join(WORD.findall(clause.lower()))


class Tagger:
    """What the features of clauses are made from."""

    def __init__(self, aligner: Aligner):
        self.names = aligner.names
        self.forms = {z for zs in aligner.lexicon.values() for z in zs if len(z) >= 2}
        self.forms |= {z[:-1] for z in self.forms if z.endswith("的") and len(z) > 2}
        self.signs = {c for options in aligner.names.table.values() for chars, _ in options[:1] for c in chars}
        run = "[A-Za-zÀ-ɏ'’\\-]{2,}"
        self.name_run = re.compile(run + "|[" + "".join(map(re.escape, sorted(self.signs))) + "]{2,}") if self.signs else re.compile(run)
        self.repeated: frozenset[str] = frozenset()  # letters of the sample's clauses that stand under several prompts
        self._things = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_things": None}

    def folded(self, s: str) -> str:
        """The glossary words as one symbol each, the longest that begins first."""
        if self._things is None:
            import ahocorasick

            self._things = ahocorasick.Automaton()
            for z in self.forms:
                self._things.add_word(z, len(z))
            self._things.make_automaton()
        out, at = [], 0
        for end, size in self._things.iter_long(s):
            out += (s[at : end + 1 - size], "W")
            at = end + 1
        return "".join(out) + s[at:]

    def frame(self, sentence: str) -> str:
        """The sentence with names, numbers and glossary words folded to one symbol each."""
        s = self.folded(sentence) if self.forms else sentence
        s = re.sub(r"\d[\d,.]*", "#", re.sub(r"\s+", "", s))
        return re.sub("N+", "N", self.name_run.sub("N", s.replace("W", "\x01")).replace("\x01", "W"))

    def last_name(self, body: str) -> str:
        """The run of letters that may be a name at the very end."""
        for inside in (self.signs.__contains__, LETTER.__contains__):
            k = len(body)
            while k and inside(body[k - 1]):
                k -= 1
            if len(body) - k >= 2:
                return body[k:]
        return ""

    def apart(self, part: str, prompt: tuple[str, set[str], bool, bool, list[str]]) -> bool:
        """Whether the clause says nothing of the prompt, though that has names or numbers to speak of."""
        low, words, _, _, names = prompt
        text = part.strip().lower()
        if not (names or re.search(r"\d", low)) or re.search(r"\d", text) or sum(map(len, WORD.findall(text))) < 4:
            return False
        han, latin = len(HAN.findall(text)), LATIN.findall(text)
        if sum(map(len, latin)) > han:
            return len(latin) >= 3 and not any(len(w) >= 5 and w in words for w in latin)
        return not set("NW#") & set(self.frame(QUOTED.sub("“", part)))

    def prompt(self, en: str | None) -> tuple[str, set[str], bool, bool, list[str]]:
        """(lower case, words, trails off, ends like a sentence, its names in Chinese)."""
        if en is None:
            return "", set(), False, True, []
        low = en.lower()
        tail = low.rstrip(" \t\r\n”\"'’»)—–-")
        names = []
        for w in set(TOKEN.findall(low)):
            if len(w) >= 4 and not w[0].isdigit():
                zh, _ = self.names.write(w)
                if len(zh) >= 2:
                    names.append(zh)
        return low, set(LATIN.findall(low)), tail.endswith(("…", "..")), tail.endswith((".", "!", "?", ";", "…")), names

    def features(self, parts: list[str], prompt: tuple[str, set[str], bool, bool, list[str]]) -> list[list[str]]:
        low, words, trails, ended, names = prompt
        out = []
        for k, part in enumerate(parts):
            text = part.strip().lower()
            han = len(HAN.findall(text))
            latin_words = LATIN.findall(text)
            latin = sum(map(len, latin_words))
            letters = sum(map(len, WORD.findall(text)))
            other = max(0, letters - han - latin)
            total = max(letters, 1)
            f = ["bias"]
            f.append(f"han{min(9, han * 10 // total)}")
            f.append(f"other{min(3, other * 10 // total)}")
            share = min(9, latin * 10 // total)
            f.append(f"latin{share}")
            if latin_words:
                plain = [w for w in latin_words if len(w) > 1]
                shared = sum(w in words for w in plain) if plain else 0
                overlap = shared * 6 // max(len(plain), 1)
                some = min(3, len(plain) // 3)
                f += [f"per{min(4, han // len(latin_words))}", f"overlap{overlap}", f"overlap{overlap}&{some}", f"overlap{overlap}&{share // 4}", "known" if words else "alone"]
                if share >= 4:
                    f += ["w=" + w for w in latin_words if w not in words]
            bare = QUOTED.sub("“", part) if ("“" in part or '"' in part) else part
            if han and "“" not in bare:
                f += ["b=" + bare[i : i + 2] for i in range(len(bare) - 1) if bare[i] > "ÿ" and bare[i + 1] > "ÿ"]
            elif han:
                f.append("quotes")
            f.append(f"size{min(4, letters // 6)}")
            if k == len(parts) - 1:
                f.append("last")
                if (han or not letters) and not other:
                    f += self.ending(part, trails, ended, names, len(parts))
            out.append(f)
        return out

    def ending(self, part: str, trails: bool, ended: bool, names: list[str], parts: int) -> list[str]:
        stripped = part.strip()
        mark = END.search(stripped).group()
        body = stripped[: len(stripped) - len(mark)]
        opened = stripped.count("“") > stripped.count("”") or stripped.count("（") > stripped.count("）")
        kind = "open" if OPEN_END.search(stripped) else "dots" if "…" in mark or ".." in mark else "stop" if re.search("[。！？!?.]", mark) else "none" if not mark.strip() else "other"
        frame = self.frame(body.rsplit("；", 1)[-1])
        head, n = frame[:3], len(frame)
        last_run = self.last_name(body)
        name = "-"
        if last_run:
            name = "full" if any(last_run.endswith(z) for z in names) else "part" if any(last_run.endswith(z[:c]) for z in names for c in range(1, len(z))) else "some"
        elif body[-1:] and any(z.startswith(body[-1:]) for z in names):
            name = "start"
        signature = f"{frame.count('N')}{frame.count('W')}{frame.count('#')}{frame.count('，')}"
        tail = frame[-2:]
        first = frame.rsplit("，", 1)[-1]
        return [
            f"mark={kind}", f"mark={kind}&{trails}", f"mark={kind}&{ended}", f"mark={kind}&{parts == 1}", f"opened{opened}", f"name={name}", f"name={name}&{frame[-3:]}",
            f"t1={frame[-1:]}", f"t2={tail}", f"t3={frame[-3:]}", f"t4={frame[-4:]}", f"h={head}", f"h={head}&{tail}", f"h={head}&{signature}&{frame[-1:]}",
            f"h={head}&{signature}", f"clause={first[:3]}&{first[-2:]}", f"clause={first}", f"frame={frame}", f"sig={signature}&{tail}", f"few{min(n, 8)}", f"fields{min(3, frame.count('：'))}&{tail}",
            *[f"in={head}&{g}" for g in {frame[i : i + 2] for i in range(3, n - 1)}],
        ]


def rule_label(part: str, words: set[str]) -> int:
    """Label of a clause of the sample by plain rules."""
    text = part.strip().lower()
    bare = QUOTED.sub("", text)
    letters = sum(map(len, WORD.findall(text))) or 1
    latin_words = [w for w in LATIN.findall(text) if len(w) > 1]
    latin, han = sum(map(len, LATIN.findall(text))), len(HAN.findall(text))
    shared = sum(w in words for w in latin_words) / max(len(latin_words), 1)
    if (letters - latin - han) / letters > 0.12:
        return FOREIGN
    if latin / letters > 0.5 and len(latin_words) >= 2 and shared >= 0.6 and han < len(latin_words):
        return ECHO
    if REFUSALS.search(bare) and len(bare) > 0.7 * len(text):
        return REFUSAL
    if latin / letters > 0.6 and len(latin_words) >= 3 and shared < 0.5:
        return FOREIGN
    return ANSWER


def training(tagger: Tagger, rows: list[tuple[str, str | None]], seed: int = 5) -> tuple[list[list[list[str]]], list[list[int]]]:
    """Sequences and labels from (response, prompt) rows: as they are, and with their last clause left out or cut."""
    rng = random.Random(seed)
    xs, ys = [], []
    for zh, en in rows:
        parts = clauses(zh)
        if not parts:
            continue
        prompt = tagger.prompt(en)
        labels = [rule_label(p, prompt[1]) for p in parts]
        if any(letters_of(p) in tagger.repeated for p in parts) and all(tagger.apart(p, prompt) for p in parts):
            labels = [REFUSAL if y == ANSWER or (y == FOREIGN and LATIN.search(p.lower())) else y for p, y in zip(parts, labels)]
        plain = all(y == ANSWER for y in labels)
        if not plain or len(parts) == 1:
            stops = re.search("[。！？!?”）]|(?<![.])[.]$", END.search(zh.strip()).group())
            if plain and (OPEN_END.search(zh.strip()) or not stops and not prompt[2] and prompt[3] and en is not None):
                labels[-1] = UNFINISHED
            for _ in range(1 if plain else 3):
                xs.append(tagger.features(parts, prompt))
                ys.append(labels)
        for _ in range(2):
            if plain and len(parts) >= 2:
                keep = parts[: rng.randint(1, len(parts) - 1)]
            elif plain and rng.random() < 0.5:
                keep = parts[:]
            else:
                continue
            if len(keep) >= 2 and rng.random() < 0.12:  # sentences that the translation runs together
                joined = END.sub("", keep[-2]) + rng.choice("，；") + keep[-1].lstrip()
                keep = [*keep[:-2], joined]
            whole = keep[-1].strip()
            body = whole[: len(whole) - len(END.search(whole).group())]
            cut = rng.random() < 0.5 and len(body) >= 4
            if cut:
                keep[-1] = body[: rng.randint(1, len(body) - 1)] + rng.choice(BREAKS)
            elif len(parts) == 1:
                continue
            trails = False
            if not cut and not whole.endswith("”") and rng.random() < 0.06:
                keep[-1], trails = body + "……", True
            xs.append(tagger.features(keep, (prompt[0], prompt[1], trails, prompt[3], prompt[4])))
            ys.append([ANSWER] * (len(keep) - 1) + [UNFINISHED if cut else ANSWER])
    return xs, ys


def verdict(parts: list[str], tags: np.ndarray) -> str | None:
    if not parts:
        return "empty"
    size = np.array([len(p.strip()) for p in parts], float)
    share = np.bincount(tags, size, 5) / max(size.sum(), 1)
    for tag, name in DEFECT.items():
        if share[tag] >= HALF:
            return name
    if share[REFUSAL] + share[ECHO] + share[FOREIGN] >= HALF:
        return DEFECT[max(DEFECT, key=lambda t: share[t])]
    return "truncated" if tags[-1] == UNFINISHED else None


def with_words_of(aligner: Aligner, glossary: DataFrame, prompts: list[str]) -> Aligner:
    """The aligner with the common glossary words that ``prompts`` have, as bounded as those are."""
    spark = glossary.sparkSession
    words = sorted({w for en in prompts for w in re.findall(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*", en.lower())})
    if not words:
        return aligner
    met = F.broadcast(spark.createDataFrame([(w,) for w in words], "word string"))
    forms = glossary_forms(glossary).withColumn("word", F.regexp_extract("low", TEXT_WORDS, 0)).join(met, "word", "left_semi")
    rows = forms.groupBy("low").agg(F.max("common").alias("common"), F.collect_set("zh").alias("zh")).filter("common = 1").collect()
    return Aligner(aligner.names, aligner.lexicon | {r.low: sorted(r.zh) for r in rows})


def fit(versions: DataFrame, english: DataFrame, aligner: Aligner, rewrites: dict[str, str], glossary: DataFrame | None = None) -> tuple[Tagger, Crf]:
    """versions: sha, zh; english: sha, en. The sample is taken before the join and is the same for the same data,
    whatever the partitions."""
    hashed = versions.filter("zh is not null").select("sha", "zh", F.xxhash64("sha", "zh").alias("h"))
    odd = F.col("zh").rlike("(?i)" + REFUSALS.pattern) | (F.regexp_count("zh", F.lit(r"\p{IsHan}")) * 2 < F.length("zh"))
    # hashes first: they are made distinct where rows are small, so that copies take no place of others
    marked = stage(hashed.select("h", F.xxhash64("zh").alias("z"), F.xxhash64("sha").alias("s"), odd.alias("odd"), F.col("zh").rlike(r"[\p{L}\p{N}]").alias("says")), "marked")
    again = stage(marked.filter("says").select("z", "s").distinct().groupBy("z").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= PROMPTS).select("z"), "again")
    classes = [(marked, SAMPLE), (marked.filter("odd"), ODD), (marked.filter("says").join(again, "z", "left_semi"), REPEATED)]
    chosen = [rows.select("h").distinct().orderBy("h").limit(most).withColumn("k", F.lit(k)) for k, (rows, most) in enumerate(classes)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]).unionByName(chosen[2]))  # at most SAMPLE + ODD + REPEATED hashes
    sample = stage(hashed.join(picked, "h").dropDuplicates(["h", "k"]).select("sha", "zh", F.xxhash64("zh").alias("z")), "sample")  # small, and read twice
    sample = sample.join(again.withColumn("again", F.lit(True)), "z", "left")
    own = english.join(F.broadcast(sample.select("sha").distinct()), "sha", "left_semi").groupBy("sha").agg(F.min("en").alias("en"))
    rows = sorted(((r.zh, r.en, bool(r.again), r.sha or "") for r in sample.join(own, "sha", "left").select("sha", "zh", "en", "again").collect()), key=lambda r: (r[0], r[1] or "", r[3]))
    form = Rewriter(rewrites)
    if glossary is not None:
        aligner = with_words_of(aligner, glossary, [form(en) for _, en, *_ in rows if en])
    tagger = Tagger(aligner)
    prompts: dict[str, set[str]] = {}
    for zh, _, again, sha in rows:
        for part in clauses(form(zh)):
            prompts.setdefault(letters_of(part), set()).update((sha, "", " ") if again else (sha,))
    tagger.repeated = frozenset(part for part, of in prompts.items() if len(of) >= PROMPTS)
    xs, ys = training(tagger, [(form(zh), form(en)) for zh, en, *_ in rows])
    tagger.repeated = frozenset()
    return tagger, Crf(5).fit(xs, ys)


def defects(pairs: DataFrame, tagger: Tagger, crf: Crf, rewrites: dict[str, str]) -> DataFrame:
    """pairs: seq, sha, zh, en. Out: seq, defect."""
    ship(pairs.sparkSession)
    shared = pairs.sparkSession.sparkContext.broadcast((tagger, crf, rewrites))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, field, table = shared.value
        form = Rewriter(table)
        for batch in batches:
            texts = list(zip(batch["sha"].tolist(), batch["zh"].tolist(), batch["en"].tolist()))
            place: dict[tuple, int] = {}  # the versions of one text lie together: most are tagged once
            parts, sequences, last = [], [], (None, None)
            for t in texts:
                if t in place:
                    continue
                place[t] = len(parts)
                pieces = clauses(form(t[1])) if t[1] else []
                if pieces and not any(c.isalnum() for c in t[1]):
                    pieces = []
                parts.append(pieces)
                if last[0] != t[2] or last[1] is None:
                    last = (t[2], own.prompt(form(t[2])))
                sequences.append(own.features(pieces, last[1]) if pieces else [])
            tags = field.decode(sequences)
            found = [verdict(p, t) for p, t in zip(parts, tags)]
            yield pd.DataFrame({"seq": batch["seq"], "defect": [found[place[t]] for t in texts]})

    return pairs.mapInPandas(run, "seq long, defect string").filter("defect is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq LONG, defect STRING."""
    paragraphs, log = load(spark, sf_dir, "paragraphs"), load(spark, sf_dir, "translations")
    lookalikes = Lookalikes.fit(paragraphs.select(F.col("en").alias("text")).unionByName(log.select(F.col("zh").alias("text"))), usual_first=True)
    versions = log.filter("seq is not null").select("seq", F.lower("sha").alias("sha"), "zh")
    en = paragraphs.filter("sha is not null and en is not null").groupBy(F.lower("sha").alias("sha")).agg(F.min("en").alias("en"))
    glossary = load(spark, sf_dir, "glossary")
    tagger, crf = fit(versions, paragraphs.filter("en is not null").select(F.lower("sha").alias("sha"), "en"), Aligner(fit_names(glossary), {}), lookalikes.rewrites, glossary)
    # deliveries of one version get one verdict, so they are made one after tagging, where rows are small
    return defects(salted_join(versions, en, ["sha"], F.col("seq")), tagger, crf, lookalikes.rewrites).distinct()
