"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds labelled text as it stands. A text is cut
greedily into phrases, each the longest match from where the last one ended, across
words and lines. A phrase costs the logarithm of the language's learnt bytes, and the
language of least cost per byte wins. Text is UTF-8 bytes, lower-cased, runs of what is neither letter nor mark as one space.

A worker parses all texts of a batch in step. Long texts are cut into segments that
are first parsed each for itself. A true phrase that crosses into a segment is then
followed until it ends where the segment's own parse begins a phrase too; from there
on both are the same. So the phrases are those of one parse of the whole text.

The automata are fitted on a bounded sample of labelled rows: per language those of
smallest hash, at most `sample_docs` and together at most `sample_bytes` (the
shortest row alone, if none is so short). Every text is scored whole.

Defined cases: null or empty text, or one without a letter: `und`, score 0. Ties go to
the first language by code point. With no labelled text every prediction is `und`. A
row without doc_id is a row like any other. Rows that repeat are predicted one by
one, and are learnt once. Texts of any length, with or without spaces, are parsed
alike. An empty table gives no rows. Other columns are handed on, but for lang_pred
and score, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanlake.llm.common import materialize, read, small_batches, text_bytes, trimmed

UNKNOWN = "und"
SAMPLE_DOCS = 300
SAMPLE_BYTES = 40_000
#: Bytes of a segment of a text.
SEGMENT = 512


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of `text`; state 0
    is the start. Online construction, linear in the text."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nexts


def normal(column) -> pa.Array:
    """Texts as they are parsed; null is empty."""
    column = pc.fill_null(pa.array(column, pa.large_string()) if isinstance(column, list) else column.cast(pa.large_string()), "")
    return pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{M}]+", " ")


def fit(texts: dict[str, list[str]]) -> dict[str, tuple[int, np.ndarray, float]]:
    """Texts by language to, for each language, the number of states, the transitions
    as (state, byte, next) and the cost of a phrase."""
    out = {}
    for lang in sorted(texts):
        learnt = "\n".join(normal(texts[lang]).to_pylist()).encode()
        nexts = suffix_automaton(learnt)
        out[lang] = len(nexts), np.array([(s, c, t) for s, d in enumerate(nexts) for c, t in d.items()], dtype=np.int32).reshape(-1, 3), float(np.log2(len(learnt) + 2))
    return out


class Parser:
    """Phrase counts of texts under each language."""

    def __init__(self, model: dict[str, tuple[int, np.ndarray, float]]):
        self.langs = list(model)
        self.cost = np.array([cost for _, _, cost in model.values()])
        seen = np.unique(np.concatenate([e[:, 1] for _, e, _ in model.values()]))
        self.kind = np.full(256, len(seen), dtype=np.int32)
        self.kind[seen] = np.arange(len(seen))
        width = len(seen) + 1
        # By state and kind of byte: the next state's row, times 2, plus 1 if a phrase
        # begins at this byte. Where the state has no such step, the start's applies.
        self.tables = []
        for n, edges, _ in model.values():
            step = np.full((n, width), -1, dtype=np.int32)
            step[edges[:, 0], self.kind[edges[:, 1]]] = edges[:, 2]
            start = np.maximum(step[0], 0) * width * 2 + 1
            table = np.where(step >= 0, step * (width * 2), start)
            table[0] = start
            self.tables.append(table.reshape(-1))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text: its phrases under each language."""
        size = np.diff(offsets)
        parts = -(-size // SEGMENT)  # segments of each text
        text = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = offsets[:-1][text] + nth * SEGMENT
        end = np.minimum(begin + SEGMENT, offsets[1:][text])
        kinds = np.append(self.kind[data], 0)
        out = np.zeros((len(size), len(self.tables)))
        for k, table in enumerate(self.tables):
            out[:, k] = self._count(table, kinds, text, begin, end, offsets)
        return out

    def _count(self, table, kinds, text, begin, end, offsets) -> np.ndarray:
        starts = np.zeros(len(kinds), dtype=bool)  # where phrases of segments begin
        order = np.argsort(begin - end, kind="stable")  # the longest first
        length = (end - begin)[order]
        row, at = np.zeros(len(order), dtype=np.int32), begin[order]
        for i, n in enumerate(np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left").tolist()):
            code = table[row[:n] + kinds[at[:n] + i]]
            starts[at[:n] + i] = code & 1
            row[:n] = code >> 1
        # From the last phrase of each segment on: where it meets the next one's own, and the phrases until there.
        upto = np.zeros(len(starts), dtype=np.int32)
        np.cumsum(starts[:-1], out=upto[1:])
        last = np.searchsorted(upto, upto[end], "left") - 1  # the last start before `end`
        follow = np.flatnonzero(np.append(text[1:] == text[:-1], False))
        meet, extra = self._follow(table, kinds, starts, last[follow], end[follow], offsets[1:][text[follow]])
        # Along each text: a segment's own phrases from where they hold, then those until the next meeting.
        total = np.zeros(len(offsets) - 1)
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
        total[text[first]] = upto[end[first]]
        total[text[first]] -= upto[begin[first]]
        many = np.flatnonzero(np.bincount(text, minlength=len(total)) > 1)
        lane = np.full(len(text), -1)
        lane[follow] = np.arange(len(follow))
        for t, head in zip(many.tolist(), np.searchsorted(text, many).tolist()):
            s, low, high = head, int(offsets[t]), int(offsets[t + 1])
            while (j := lane[s]) >= 0:
                total[t] += extra[j]
                if (at := int(meet[j])) >= high:
                    break
                s = head + (at - low) // SEGMENT
                total[t] += upto[end[s]] - upto[at]
        return total

    @staticmethod
    def _follow(table, kinds, starts, last, edge, stop) -> tuple[np.ndarray, np.ndarray]:
        """Parse on from phrase starts `last` until a phrase begins, at `edge` or after,
        where `starts` has one too (or at `stop`, the text's end), and count those that
        begin at `edge` or after, without that one."""
        meet, extra = stop.copy(), np.zeros(len(last), dtype=np.int64)
        lanes, at, row = np.arange(len(last)), last.copy(), np.zeros(len(last), dtype=np.int32)
        while len(lanes):
            on = at < stop[lanes]
            lanes, at, row = lanes[on], at[on], row[on]
            code = table[row + kinds[at]]
            begins = ((code & 1) > 0) & (at >= edge[lanes])
            met = begins & starts[at]
            meet[lanes[met]] = at[met]
            extra[lanes[begins & ~met]] += 1
            on = ~met
            lanes, at, row = lanes[on], at[on] + 1, code[on] >> 1
        return meet, extra

    def __call__(self, column) -> tuple[list[str], list[float]]:
        texts = normal(column)
        n = len(texts)
        named = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) & bool(self.langs)
        data, offsets = text_bytes(texts)
        rate = self.phrases(data, offsets) * self.cost / np.maximum(np.diff(offsets), 1)[:, None] if self.langs else np.zeros((n, 1))
        best = rate.argmin(1) if n else np.zeros(0, np.int64)
        least = rate[np.arange(n), best]
        rest = rate.copy()
        rest[np.arange(n), best] = np.inf
        second = rest.min(1) if n else least
        score = np.where(np.isinf(second), 1.0, np.clip(1.0 - least / np.maximum(second, 1e-12), 0.0, 1.0))
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), named.tolist())], np.where(named, score, 0.0).tolist()


def sample(docs: DataFrame, learn, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """Labelled texts by language, each once: those of smallest hash, at most
    `sample_docs` and `sample_bytes` together, or the shortest alone."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & (F.length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.withColumns({"h": F.xxhash64("lang", "text"), "g": F.xxhash64("text", "lang")})
    # A row for each text, combined in each task; each task keeps its first ones.
    sized = materialize(rows.groupBy("lang", "h", "g").agg(F.min(F.octet_length("text")).cast("long").alias("n")))
    order = Window.partitionBy("lang").orderBy("h", "g")
    # Hashes of distinct texts are spread evenly: what can't be among the first goes before they meet.
    counts = {r.lang: r.n for r in sized.filter(F.col("n") <= sample_bytes).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    near = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(2.0**63 * (min(2.0, 2.0 * (sample_docs + 10 * sample_docs**0.5 + 10) / n) - 1) * (1 - 1e-15))))) if counts else F.lit(None).cast("map<string,long>")
    first = sized.filter((F.col("n") <= sample_bytes) & (F.col("h") <= near[F.col("lang")])).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample_docs)
    chosen, size = {}, {}
    for r in first.orderBy("lang", "k").collect():  # at most sample_docs a language
        size[r.lang] = size.get(r.lang, 0) + r.n
        if size[r.lang] <= sample_bytes:
            chosen[r.lang, r.h, r.g] = r.k
    for r in sized.groupBy("lang").agg(F.min(F.struct("n", "h", "g")).alias("m")).collect():  # a row a language
        if r.lang not in size:
            chosen[r.lang, r.m.h, r.m.g] = 0
    out: dict[str, list[str]] = {}
    if chosen:
        wanted = docs.sparkSession.createDataFrame(list(chosen), "lang string, h long, g long")
        found = rows.join(F.broadcast(wanted), ["lang", "h", "g"]).groupBy("lang", "h", "g").agg(F.min("text").alias("text"))
        for r in sorted(found.collect(), key=lambda r: (r.lang, chosen[r.lang, r.h, r.g])):  # at most sample_bytes a language
            out.setdefault(r.lang, []).append(r.text)
    return out


def predict(docs: DataFrame, learn=None, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, model=None, keep: list[str] | None = None) -> DataFrame:
    """The rows of `docs` (all columns, or those to `keep`) with lang_pred and score.
    `learn`: a condition on the rows to learn from (all, if none)."""
    spark = docs.sparkSession
    model = model if model is not None else fit(sample(docs, F.lit(True) if learn is None else learn, sample_docs, sample_bytes))
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*names, F.col("text").alias("__text")) if "text" not in names else docs.select(*names)
    sent = spark.sparkContext.broadcast(model)  # bounded by sample_bytes a language
    at, n = names.index("text") if "text" in names else len(names), len(names)
    small_batches(spark, 500, "1m")

    def run(batches):
        parser = Parser(sent.value) if sent.value else None
        for b in batches:
            langs, scores = parser(b.column(at)) if parser else ([UNKNOWN] * b.num_rows, [0.0] * b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInArrow(trimmed(run), f"{fields}, lang_pred string, score double")


def held_out(k: int, r: int):
    return F.crc32(F.col("doc_id").cast("string")) % k == r


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text", "lang"), ~F.coalesce(held_out(5, 0), F.lit(False)), keep=["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score")
