"""Spelling variants: near words by a relational trie frontier.

The vocabulary is a trie held as an edge table ``(node, label, child, mask)``; a node is
the hash of its prefix. States ``(word, position, node, edits)`` are joined with the edges
and moved on level by level until nothing is left; states with one edit that end where a
word ends are neighbours.

Two things keep the frontier small. Two words one edit apart agree up to the edit, and
after it. If the edit lies in the second half of a word, the word's own path leads to it
in a trie of the words; if it lies in the first half, in a trie of the reversed words. So
states without an edit start at half of each word, where nodes have few children, and no
key is met by more than the short words that share half their letters. And a pair is
walked once, from the shorter word, or the smaller of two of one length.

No table is broadcast: states are the words many times over, which Spark doesn't see when
it sizes them by the table of words.

An edge also holds which letters can follow its child (``mask``, a superset), so a state
that can't go on is dropped before it is written. Edges hold one letter down to depth
``LETTERS``; below, their length doubles, so that a word of any length has few levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.session import cut, many

#: Maximal runs of letters; shorter ones can't become words, for a run only ever loses letters.
LEAST_LENGTH, LEAST_COUNT = 5, 3
RUN = r"[A-Za-zÀ-ÿ]{%d,}"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Every how many-th run, by its checksum, has lost a letter.
DAMAGED = 97
LETTERS = 64  # depth down to which an edge holds one letter
ENDS = 63  # bit of the mask for "a word ends here"
FORM_RATIO = 2


def lowered(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(run) == F.char_length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, UPPER.lower()))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of whole texts with their occurrences, where at least ``least_count``.

    A null text has no words; a null identifier counts as an empty one in the checksum.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN % least_length), F.lit(0))).alias("_run"))
    runs = runs.select("_d", lowered(F.col("_run")).alias("_run"))
    runs = runs.select("_run", F.crc32(F.concat("_d", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = F.pmod(F.col("_h"), F.char_length("_run")).cast("int")
    shorter = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % DAMAGED == 0, shorter).otherwise(F.col("_run"))
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))


def _level_at(depth: str) -> str:
    """The deepest depth up to ``depth`` at which nodes lie."""
    return f"if({depth} <= {LETTERS}, {depth}, {LETTERS} * bigint(pow(2, floor(log2({depth} / {LETTERS})))))"


def _levels(first: str, last: str) -> str:
    """Depths of a path's nodes from ``first``, which is one, to ``last``."""
    letters = f"if({first} <= {LETTERS}, sequence({first}, least({last}, {LETTERS}L)), array())"
    longer = f"if({last} <= {LETTERS}, array(), filter(transform(sequence(1, 40), k -> {LETTERS} * bigint(pow(2, k))), d -> d BETWEEN {first} AND {last}))"
    return f"concat({letters}, {longer})"


def _stride(depth: str) -> str:
    """Letters of the edges that leave a node of ``depth``."""
    return f"if({depth} < {LETTERS}, 1, int({depth}))"


def _bit(letter: str) -> str:
    return f"if({letter} = '', {ENDS}, pmod(ascii({letter}), {ENDS}))"


def _follows(text: str, depth: str) -> str:
    """Whether the mask allows what ``text`` has after ``depth`` letters."""
    return f"getbit(mask, {_bit(f'substr({text}, {depth} + 1, 1)')}) = 1"


def sides(words: DataFrame) -> DataFrame:
    """``side, text, length``: each word forwards (0) and backwards (1)."""
    both = words.selectExpr("inline(array(named_struct('side', 0, 'text', word), named_struct('side', 1, 'text', reverse(word))))")
    return both.withColumn("length", F.char_length("text").cast("long"))


def edge_table(texts: DataFrame) -> DataFrame:
    """``node, label, child, mask`` from the depth at which the shorter of two near words starts."""
    path = texts.select("side", "text", "length", F.explode(F.expr(_levels(_level_at("((length - 1) div 2)"), "(length - 1)"))).alias("depth"))
    path = path.select("side", "text", "depth", F.expr(f"substr(text, depth + 1, {_stride('depth')})").alias("label"))
    path = path.select(
        F.expr("xxhash64(side, left(text, int(depth)))").alias("node"), "label",
        F.expr("xxhash64(side, left(text, int(depth) + char_length(label)))").alias("child"),
        F.expr(f"shiftleft(1L, {_bit('substr(text, int(depth) + char_length(label) + 1, 1)')})").alias("bit"))
    return path.groupBy("node", "label", "child").agg(F.bit_or("bit").alias("mask"))


def first_edits(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """States with one edit: ``side, text, near, depth, node``.

    The states without an edit, one for each node of a word's own path from its middle, meet
    the edges of their nodes; a letter is replaced by a larger one or put in. What is left of
    ``text`` after the edit is what ``near`` must go on with.
    """
    start = _level_at("if(side = 0, length div 2, length - length div 2)")
    own = texts.select("side", "text", F.explode(F.expr(_levels(start, "length"))).alias("depth"))
    own = own.select("side", "text", F.col("depth").cast("int").alias("depth"), F.expr("xxhash64(side, left(text, int(depth)))").alias("node"))
    met = many(own).join(edges, "node").withColumn("k", F.char_length("label")).withColumn("here", F.expr("substr(text, depth + 1, k)"))
    replaced = "here < label AND char_length(here) = k AND (k = 1 OR levenshtein(here, label, 1) = 1)"
    put_in = "if(k = 1, here != label, char_length(substr(text, depth + 1, k - 1)) = k - 1 AND levenshtein(substr(text, depth + 1, k - 1), label, 1) = 1)"
    tried = met.select(
        "side", "text", "depth", "label", "k", "child", "mask",
        F.explode(F.expr(f"filter(array(if({replaced}, depth + k, null), if({put_in}, depth + k - 1, null)), p -> p IS NOT NULL)")).alias("rest"))
    states = tried.select(
        "side", "text", F.expr("concat(left(text, depth), label, substr(text, rest + 1))").alias("near"),
        (F.col("depth") + F.col("k")).alias("depth"), F.col("child").alias("node"), "mask")
    return states.where(_follows("near", "depth")).drop("mask")


def next_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The open states one edge further."""
    asked = states.where("depth < char_length(near)").withColumn("label", F.expr(f"substr(near, depth + 1, {_stride('depth')})"))
    moved = asked.join(many(edges), ["node", "label"])
    moved = moved.select("side", "text", "near", (F.col("depth") + F.char_length("label")).alias("depth"), F.col("child").alias("node"), "mask")
    return moved.where(_follows("near", "depth")).drop("mask")


def near_words(words: DataFrame) -> DataFrame:
    """``word, near``: every ordered pair of distinct words that one inserted, deleted or replaced letter parts."""
    texts = sides(words.select("word"))
    edges = cut(edge_table(texts), "trie")
    levels = [cut(first_edits(texts, edges), "frontier")]
    while not levels[-1].where("depth < char_length(near)").isEmpty():
        levels.append(cut(next_level(levels[-1], edges), "frontier"))
    ended = levels[0]
    for level in levels[1:]:
        ended = ended.unionByName(level)
    ended = ended.where("depth = char_length(near)")
    pairs = ended.select(F.expr("if(side = 0, text, reverse(text))").alias("word"), F.expr("if(side = 0, near, reverse(near))").alias("near")).distinct()
    return pairs.selectExpr("inline(array(named_struct('word', word, 'near', near), named_struct('word', near, 'near', word)))")


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` of ``links(word, form)``: forms followed to the last, twice as far in each round."""
    now = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = cut(now.join(many(ahead), "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``docs(doc_id, text)``.

    A word's form is its near word of largest ``n`` (ties: the smallest in code-point
    order) where that is at least twice the word's own; its root is the end of the chain
    of forms, which ends because ``n`` grows along it. Repeated rows count each; other
    columns are not read. Without words the result is empty.
    """
    words = cut(vocabulary(docs.select("doc_id", "text"), least_length, least_count), "words")
    ranked = near_words(words).join(many(words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))), "near")
    best = ranked.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    formed = words.join(many(best), "word", "left").withColumn("_ok", -F.col("top.less") >= FORM_RATIO * F.col("n"))
    formed = cut(formed.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("_ok"), F.col("top.near")).alias("form"), F.when(F.col("_ok"), -F.col("top.less")).alias("form_n")), "forms")
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(many(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
