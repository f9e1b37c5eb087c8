"""Words one edit apart, and the spelling each of them is a variant of (operator 11).

Sorted-list dynamic programming: in a sorted list, words with a common prefix lie in
one range and share the first rows of the edit matrix against a given word. A row
of three cells (one insertion, none, one deletion) is computed once for a range, from
the row of the range around it; a range whose row holds no cell of at most one edit
is skipped with all words in it. All words of a task walk its list at once.

The vocabulary is dealt so that words one edit apart share a group: their left or their
right half is equal. Overfull groups are cut further by halving what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import cut

PATTERN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS = 5
MIN_COUNT = 3
NOISE = 97  # a run whose hash this divides loses a code point
GROUP = 512  # members of a group; a larger one is cut further
HELD_WORDS = 1 << 15  # members of groups that a task scans at once
QUERIES = 1 << 12  # words that walk the lists at once
NO_CAP = 1 << 30


# --- vocabulary ----------------------------------------------------------------


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts and how often they occur.

    A run whose crc32 with its document's id is a multiple of NOISE loses the code point
    that the hash names. A null id counts as an empty one.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), upper, upper.lower()), F.lit(PATTERN), F.lit(0))
    words = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = words.filter(F.length("run") >= min_chars)  # no run grows
    words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = words.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("run")).alias("word"))
    counts = words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


# --- groups --------------------------------------------------------------------
#
# A group (least, left, right, the characters themselves) holds words of ``least`` or
# ``least`` + 1 characters with the same first ``left`` and last ``right`` characters. Two words
# of it are compared if the shorter has ``least``. ``cap``: a pair with so long a common
# prefix or a longer one belongs to another group.


def group_key(left: Column, right: Column) -> Column:
    word = F.col("word")
    return F.concat_ws(
        "/", F.col("least"), left, right, F.substring(word, F.lit(1), left),
        F.when(right > 0, F.substring(word, F.length(word) - right + 1, right)).otherwise(F.lit("")),
    )


def halves(rows: DataFrame) -> DataFrame:
    """Rows (word, n, least, left, right, cap) with their groups' rest cut in two: the left or the right half is equal, too.

    Only the left half's group has the pairs for which both hold.
    """
    half = F.floor((F.col("least") - F.col("left") - F.col("right")) / 2).cast("int")
    rest = F.col("least") - F.col("left") - F.col("right") - half
    one = F.struct((F.col("left") + half).alias("left"), F.col("right"), F.col("cap"))
    two = F.struct(F.col("left"), (F.col("right") + rest).alias("right"), F.least("cap", F.col("left") + half).alias("cap"))
    out = rows.select("word", "n", "least", F.inline(F.array(one, two)))
    return out.filter("left < cap").withColumn("key", F.concat_ws("/", "cap", group_key(F.col("left"), F.col("right"))))


def scanned(groups: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): what each member of a group is near to, in its group.

    Groups are read as a stream; some thousand words are held at a time.
    """
    columns = ["key", "word", "n", "least", "left", "right", "cap"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key = [], None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if row[0] != open_key:
                    if len(held) >= HELD_WORDS:
                        yield nearest(held)
                        held = []
                    open_key = row[0]
                held.append(row)
        if held:
            yield nearest(held)

    dealt = groups.select(*columns).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")


def nearest(rows: list[tuple]) -> pa.RecordBatch:
    """``scanned`` of whole groups."""
    # The longer shared end comes first: a list turned round has the shared right ends as its prefixes.
    lists = sorted(((key, word[::-1] if right > left else word, word, n, least, max(left, right), cap) for key, word, n, least, left, right, cap in rows))
    a, b = near_pairs([x[0] for x in lists], [x[1] for x in lists], np.array([x[5] for x in lists]), QUERIES)
    words = [x[2] for x in lists]
    n, least, cap = (np.array([x[i] for x in lists], np.int64) for i in (3, 4, 6))
    size = np.fromiter(map(len, words), np.int64, len(words))
    keep = np.minimum(size[a], size[b]) == least[a]
    a, b = a[keep], b[keep]
    some = np.flatnonzero(cap[a] < NO_CAP)
    common = np.array([common_prefix(words[i], words[j]) for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True)], np.int64)
    keep = np.ones(len(a), bool)
    keep[some] = common < cap[a[some]]
    a, b = a[keep], b[keep]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(a)))
    cols = [pa.array([words[i] for i in a[first].tolist()], pa.string()), pa.array(count), pa.array(n[b[first]]), pa.array([words[i] for i in b[first].tolist()], pa.string())]
    return pa.RecordBatch.from_arrays(cols, names=["word", "n_near", "form_n", "form"])


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


# --- the scan ------------------------------------------------------------------


def adjacent_prefixes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each word with the one before; -1 where ``same`` is false (another list)."""
    out = np.full(len(start), -1, np.int64)
    live = np.flatnonzero(same)
    out[live] = 0
    depth = 0
    while len(live):
        live = live[(size[live] > depth) & (size[live - 1] > depth)]
        live = live[flat[start[live] + depth] == flat[start[live - 1] + depth]]
        depth += 1
        out[live] = depth
    return out


def near_pairs(keys: list[str], words: list[str], shared: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the pairs of words of one list at exactly one edit, in both directions.

    ``words`` are sorted within each key, and the words of a key differ and share their
    first ``shared`` characters.
    """
    total = len(words)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, total)
    start = np.cumsum(size) - size
    same = np.array([False, *(x == y for x, y in zip(keys[1:], keys, strict=False))], bool)
    lcp = adjacent_prefixes(flat, start, size, same)
    first = np.flatnonzero(~same)
    end = np.append(first[1:], total)
    members = end - first
    # Positions that begin a new range at a depth, by depth: (depth, position) in order.
    by_depth = np.lexsort((np.arange(total), lcp))
    depth_at = lcp[by_depth]
    out_a, out_b = [], []
    own = np.repeat(np.arange(len(first)), members)  # the list of each word
    walkers = np.flatnonzero(members[own] > 1)
    walkers = walkers[np.argsort(shared[walkers], kind="stable")]
    for at in range(0, len(walkers), queries):
        todo = walkers[at : at + queries]
        begins = shared[todo]
        empty = np.zeros(0, np.int64)
        q, low, high, one, none, more = (empty,) * 6
        depth, used = int(begins[0]), 0
        while len(q) or used < len(todo):
            if not len(q):
                depth = max(depth, int(begins[used]))
            # Words whose lists share their first ``depth`` characters begin here: the row of equal prefixes.
            until = int(np.searchsorted(begins, depth, "right"))
            new = todo[used:until]
            used = until
            if len(new):
                k = np.ones(len(new), np.int64)
                q, low, high = np.append(q, new), np.append(low, first[own[new]]), np.append(high, end[own[new]])
                one, none = np.append(one, np.where(begins[until - len(new) : until] > 0, k, 2)), np.append(none, k * 0)
                more = np.append(more, np.where(size[new] > depth, k, 2))
            # A word that ends here comes first in its range.
            ends = size[low] == depth
            if ends.any():
                i = np.flatnonzero(ends)
                gap = size[q[i]] - depth
                edits = np.select([gap == -1, gap == 0, gap == 1], [one[i], none[i], more[i]], 2)
                hit = i[edits == 1]
                out_a.append(q[hit])
                out_b.append(low[hit])
                low = low + ends
            keep = low < high
            q, low, high, one, none, more = (x[keep] for x in (q, low, high, one, none, more))
            if not len(q):
                depth += 1
                continue
            # Ranges of the next depth: each begins at ``low`` or where the common prefix is ``depth``.
            cuts = by_depth[np.searchsorted(depth_at, depth) : np.searchsorted(depth_at, depth, "right")]
            a, z = np.searchsorted(cuts, low, "right"), np.searchsorted(cuts, high)
            n = np.maximum(z - a, 0) + 1
            of = np.repeat(np.arange(len(q)), n)
            step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            padded = np.append(cuts, 0)
            low2 = np.where(step == 0, low[of], padded[np.minimum(a[of] + step - 1, len(cuts))])
            high2 = np.where(step == n[of] - 1, high[of], padded[np.minimum(a[of] + step, len(cuts))])
            q, one, none, more = q[of], one[of], none[of], more[of]
            low, high = low2, high2
            # The next row: the new character against the query's characters around the diagonal.
            x = flat[start[low] + depth]
            length = size[q]

            def differs(place: np.ndarray, x: np.ndarray = x, length: np.ndarray = length, base: np.ndarray = start[q]) -> np.ndarray:
                ok = (place >= 0) & (place < length)
                return np.where(ok, flat[base + np.where(ok, place, 0)] != x, 2)

            one2 = np.minimum(one + differs(np.full(len(q), depth - 1)), none + 1)
            one2 = np.where(depth <= length, one2, 2)
            none2 = np.minimum(np.minimum(none + differs(np.full(len(q), depth)), more + 1), one2 + 1)
            none2 = np.where(depth + 1 <= length, none2, 2)
            more2 = np.minimum(more + differs(np.full(len(q), depth + 1)), none2 + 1)
            more2 = np.where(depth + 2 <= length, more2, 2)
            depth += 1
            live = np.minimum(np.minimum(one2, none2), more2) <= 1
            q, low, high, one, none, more = (v[live] for v in (q, low, high, one2, none2, more2))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


# --- forms ---------------------------------------------------------------------


def near_words(words: DataFrame, group: int = GROUP, min_chars: int = 1) -> DataFrame:
    """(word, n_near, form_n, form) for each word of ``words(word, n)`` with a near word; the near word of largest n.

    No word has fewer than ``min_chars`` characters. A group of more than ``group``
    members is not scanned as a whole: it is cut further until what is left is at
    most one character, when its size is bounded by the alphabet. No pair is lost.
    """
    least = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("least")
    rows = words.select("word", "n", least).filter(F.col("least") >= min_chars)
    rows = rows.withColumns({"left": F.lit(0), "right": F.lit(0), "cap": F.lit(NO_CAP)})
    found = None
    while True:
        rows = cut(halves(rows), "spelling-groups")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.first(F.col("least") - F.col("left") - F.col("right")).alias("rest"))
        over = cut(sizes.filter((F.col("members") > group) & (F.col("rest") > 1)).select("key"), "spelling-over")
        some = cut(scanned(rows.join(over, "key", "left_anti")), "spelling-near")
        found = some if found is None else found.unionByName(some)
        rows = rows.join(over, "key", "left_semi").drop("key")
        if over.isEmpty():
            break
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) with no null: the last word reached by following forms. Steps double each round."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if more.filter("moved").isEmpty():
            return more.select("word", "root")
        at = more.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs``.

    ``form`` is the near word of largest count, ties to the smallest in code-point order, if it
    is at least twice as frequent as the word; ``root`` follows forms to the last. Null texts have
    no words, repeated rows count again, words may be of any length. Other columns are
    ignored. An empty table gives no rows.
    """
    words = cut(vocabulary(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), "id", "text", min_chars, min_count), "spelling-words")
    near = near_words(words, group, min_chars)
    joined = words.join(near.withColumnRenamed("word", "_word"), words["word"] == F.col("_word"), "left").drop("_word")
    common = F.col("form_n") >= 2 * F.col("n")
    out = cut(
        joined.select(
            "word", F.when(common, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(common, F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(out.filter("form is not null").select("word", "form"))
    with_root = out.join(ends.withColumnRenamed("word", "_word"), out["word"] == F.col("_word"), "left")
    return with_root.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
