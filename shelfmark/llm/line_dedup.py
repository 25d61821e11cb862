"""Line deduplication across documents by a deletion-neighbourhood join.

A line is a duplicate if an earlier line (by document id, then line number)
has the same words, or differs by one word inserted, removed or replaced. Lines
are compared after white space is collapsed; lines of fewer than `MIN_WORDS`
words are duplicates only when equal; blank lines are layout and always stay.

Two lines within one word edit share a whole half: the words before the middle
or those after it. So only lines that share a half with a different line emit
their deletion neighbourhood: every way to take one word, or none, out of the
other half, as hashed keys of (half, words left of the gap, words right of it).
The keys of a line come from running hashes of its words, so their number and
cost grow with the length of the line. Lines that meet under a key are compared
word by word with the earliest of it, and dropped if one edit apart. Groups are
reduced by aggregates that are joined back, never gathered, so a key may hold
any share of the rows.

A text is known by its `doc_id` and a hash of it, so an id that repeats is no
join key of its own.

Only DataFrame functions run here. Defined cases: a null text stays null and an
empty text is one blank line; rows whose `doc_id` is null take no part and stay
as they are; rows that repeat a `doc_id` with different texts are documents of
their own, in the order of the hash of their text; rows equal in `doc_id` and
text are one document and change alike; an empty table gives an empty table;
further columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.text import let
from shelfmark.session import materialize

MIN_WORDS = 4
CHUNK = 1000  # words over which running hashes are built at a time
TEXT = ["doc_id", "row"]
LINE = [*TEXT, "line_no"]


def _words_in(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1).cast("int")


def _head(line: Column, n: Column) -> Column:
    """The first n words of a collapsed line, or the last ones for negative n."""
    return F.call_function("substring_index", line, F.lit(" "), n)


def _key(side: str, words: Column, n: Column) -> Column:
    return F.xxhash64(words, F.lit(side), n)


def _texts(documents: DataFrame) -> DataFrame:
    """(doc_id, row, text): the rows that take part; `row` tells the texts of one id apart."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select("doc_id", F.xxhash64("text").alias("row"), "text")


def _collapsed(raw: Column) -> Column:
    return F.trim(F.regexp_replace(raw, r"[\x20\x09-\x0D]+", " "))


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line, n): the non-blank lines, white space collapsed, with their word count."""
    rows = _texts(documents).select(*TEXT, F.posexplode(F.split("text", "\n")).alias("line_no", "_raw"))
    return rows.select(*LINE, _collapsed(F.col("_raw")).alias("line")).where("line != ''").withColumn("n", _words_in(F.col("line")))


def _halves(rows: DataFrame) -> DataFrame:
    """Adds the hashed halves of a line: p (first n div 2 words), s (the rest) and x.

    x is the half one word shorter that meets lines of n - 1 words: of the
    first words for even n, of the last words for odd n.
    """
    n, line = F.col("n"), F.col("line")
    h = F.expr("n div 2").cast("int")
    s = n - h
    even = n % 2 == 0
    return rows.withColumns({
        "p": _key("p", _head(line, h), h),
        "s": _key("s", _head(line, -s), s),
        "x": F.when(even, _key("p", _head(line, h - 1), h - 1)).otherwise(_key("s", _head(line, 1 - s), s - 1)),
    })


def first_lines(documents: DataFrame) -> DataFrame:
    """(n, p, s, x, pos): every distinct line with its earliest position."""
    rows = _halves(lines(documents))
    return rows.groupBy("n", "p", "s", "x").agg(F.min(F.struct(*LINE)).alias("pos"))


def _sharing(firsts: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, key, side, size): halves that a line shares with a different line."""
    even = F.col("n") % 2 == 0
    h = F.expr("n div 2").cast("int")
    entry = [
        F.struct(F.col("p").alias("key"), F.lit("p").alias("side"), h.alias("size")),
        F.struct(F.col("s").alias("key"), F.lit("s").alias("side"), (F.col("n") - h).alias("size")),
        F.struct(
            F.col("x").alias("key"), F.when(even, F.lit("p")).otherwise(F.lit("s")).alias("side"),
            F.when(even, h - 1).otherwise(F.col("n") - h - 1).alias("size"),
        ),
    ]
    posts = firsts.where(F.col("n") >= MIN_WORDS).select("pos.*", F.inline(F.array(*entry)))
    shared = posts.groupBy("key").agg(F.count("*").alias("_c")).where("_c > 1").select("key")
    return posts.join(shared, "key")


def _shared_lines(documents: DataFrame, sharing: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, words, halves): the lines that share halves, with those halves (three at most)."""
    by_line = sharing.repartition(*TEXT).groupBy(*LINE).agg(F.collect_list(F.struct("key", "side", "size")).alias("halves"))
    wanted = by_line.groupBy(*TEXT).agg(F.collect_list(F.struct("line_no", "halves")).alias("_w"))
    texts = _texts(documents).groupBy(*TEXT).agg(F.first("text").alias("text"))
    rows = texts.join(wanted, TEXT).select(*TEXT, F.split("text", "\n").alias("_lines"), F.explode("_w").alias("_e"))
    line = _collapsed(F.get("_lines", F.col("_e.line_no")))
    return rows.select(*TEXT, "_e.line_no", F.split(line, " ").alias("words"), "_e.halves")


def _running(hashes: Column) -> Column:
    """The hashes of the first 0, 1, ... elements, each combined by exclusive or."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(hashes, zero, lambda done, h: F.array_append(done, F.element_at(done, -1).bitwiseXOR(h)))


def _prefix_hashes(hashes: Column) -> Column:
    """`_running`, chunk by chunk for long arrays, which appending would copy over and over."""
    def chunked(h: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(h) - 1) / CHUNK).cast("int"))
        parts = F.transform(numbers, lambda c: _running(F.slice(h, c * CHUNK + 1, CHUNK)))

        def shifted(p: Column) -> Column:
            before = _running(F.transform(p, lambda x: F.element_at(x, -1)))
            own = let(before, lambda b: F.transform(p, lambda x, c: F.transform(
                F.slice(x, 2, CHUNK), lambda v: v.bitwiseXOR(F.get(b, c)))))
            return F.concat(F.array(F.lit(0).cast("long")), F.flatten(own))

        return let(parts, shifted)

    return let(hashes, lambda h: F.when(F.size(h) <= CHUNK, _running(h)).otherwise(chunked(h)))


def _variants(key: Column, rest: Column) -> Column:
    """Hashed keys of `rest` with nothing taken out at each gap, and with the word that follows the gap taken out."""
    def keys(r: Column, m: Column) -> Column:
        left = _prefix_hashes(F.transform(r, lambda w, i: F.xxhash64(w, i)))
        # Words right of a gap are numbered from the end, so that taking one out does not renumber them.
        right = _prefix_hashes(F.transform(r, lambda w, i: F.xxhash64(w, i - m)))

        def at_gaps(p: Column, s: Column) -> Column:
            after = lambda i: F.get(s, m).bitwiseXOR(F.get(s, i))
            return F.flatten(F.transform(F.sequence(F.lit(0), m), lambda i: F.array(
                F.xxhash64(key, F.get(p, i), after(i), i, m - i),
                F.when(i < m, F.xxhash64(key, F.get(p, i), after(i + 1), i, m - i - 1)),
            )))

        return let(left, lambda p: let(right, lambda s: at_gaps(p, s)))

    return let(rest, lambda r: keys(r, F.size(r)))


def _neighbourhood(shared: DataFrame) -> DataFrame:
    """(key, doc_id, row, line_no): the hashed deletion variants of the other half of each shared half."""
    rows = shared.select(*LINE, "words", F.inline("halves"))
    w, k, total = F.col("words"), F.col("size"), F.size("words")
    rest = F.when(F.col("side") == "p", F.slice(w, k + 1, total - k)).otherwise(F.slice(w, F.lit(1), total - k))
    return rows.select(*LINE, F.explode(_variants(F.col("key"), rest)).alias("key")).where("key IS NOT NULL")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two different lists of words are one insertion, removal or replacement apart."""
    def tail(words: Column, start: Column) -> Column:
        return F.slice(words, start, F.size(words) + 1)

    def after(i: Column) -> Column:  # i: number of the first word that differs
        longer = F.size(a) - F.size(b)
        return (
            F.when(longer == 0, tail(a, i + 1) == tail(b, i + 1))
            .when(longer == 1, tail(a, i + 1) == tail(b, i))
            .when(longer == -1, tail(a, i) == tail(b, i + 1))
            .otherwise(False)
        )

    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    return let(F.array_position(same, False).cast("int"), after)


def _near(shared: DataFrame) -> DataFrame:
    """(doc_id, row, line_no) of lines one edit from an earlier line."""
    near = materialize(_neighbourhood(shared), "line-variants")
    pos = F.struct(*LINE)
    earliest = near.groupBy("key").agg(F.min(pos).alias("_first"), F.max(pos).alias("_last")).where("_first != _last").select("key", "_first")
    pairs = near.join(earliest, "key").where(pos > F.col("_first")).select(
        *LINE, *[F.col(f"_first.{c}").alias(f"_{c}") for c in LINE]
    ).distinct()
    own = shared.select(*LINE, F.col("words").alias("_a"))
    first = shared.select(*[F.col(c).alias(f"_{c}") for c in LINE], F.col("words").alias("_b"))
    verified = pairs.join(own, LINE).join(first, [f"_{c}" for c in LINE]).where(_one_edit(F.col("_a"), F.col("_b")))
    return verified.select(*LINE).distinct()


def kept_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, row, kept): the numbers of the non-blank lines that stay; texts that keep none are absent."""
    firsts = materialize(first_lines(documents), "first-lines")
    sharing = materialize(_sharing(firsts), "line-halves")
    shared = materialize(_shared_lines(documents, sharing), "shared-lines")
    kept = firsts.select("pos.*").join(_near(shared), LINE, "left_anti")
    return kept.groupBy(*TEXT).agg(F.collect_list("line_no").alias("kept"))


def _numbers(rows: Column) -> tuple[Column, Column]:
    """Numbers of all lines, and those of the non-blank ones."""
    everything = F.sequence(F.lit(0), F.size(rows) - 1)
    flags = F.transform(rows, lambda r, i: F.when(F.regexp_like(r, F.lit(r"[^\x20\x09-\x0D]")), i))
    return everything, F.array_compact(flags)


def decisions(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped): per document the numbers of the lines that go, ascending."""
    own = documents.select("doc_id", F.xxhash64("text").alias("row"), _numbers(F.split("text", "\n"))[1].alias("_filled"))
    joined = own.join(kept_lines(documents), TEXT, "left")
    none = F.array().cast("array<int>")
    dropped = F.when(F.col("doc_id").isNull(), none).otherwise(
        F.array_except(F.coalesce("_filled", none), F.coalesce("kept", none))
    )
    return joined.select(
        "doc_id", F.size(F.coalesce("_filled", none)).cast("long").alias("n_lines"), F.array_sort(dropped).alias("dropped")
    ).withColumn("n_dropped", F.size("dropped").cast("long"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """`documents` with duplicate lines taken out of `text`; a document that loses all its lines keeps an empty text."""
    kept = kept_lines(documents).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("kept").alias("__kept"))
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__row"))
    joined = documents.join(kept, same, "left").withColumn("__rows", F.split("text", "\n"))
    # The split text is a column, not repeated in the expression that picks single lines of it.
    everything, filled = _numbers(F.col("__rows"))
    none = F.array().cast("array<int>")
    dropped = F.array_except(filled, F.coalesce("__kept", none))
    rebuilt = F.array_join(F.transform(F.array_except(everything, dropped), lambda i: F.get("__rows", i)), "\n")
    text = F.when(F.col("doc_id").isNull() | F.col("text").isNull() | (F.size(dropped) == 0), F.col("text")).otherwise(rebuilt)
    return joined.withColumn("text", text).select(*documents.columns)
