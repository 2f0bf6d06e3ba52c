"""The docs index: sections (with content where the text is asked for), links, front matter and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.functions import vectors as V
from sextant.operators import graph, scan
from sextant.operators.markdown import paragraphs
from sextant.operators.nearest import nearest
from sextant.operators.scan import changed, grep, mentions, neighborhood, search, similar  # noqa: F401
from sextant.plans.storage import cut


def catalog(sections: DataFrame) -> DataFrame:
    """By folder: documents, sections, files, the first tags and titles."""
    p = X.slashed("file_path")
    hidden = F.regexp_extract(p, r"(?:^|/)(\.[^/]+/[^/]+)/", 1)
    parent = F.element_at(F.split(X.directory("file_path"), "/"), -1)
    bucket = F.when(hidden != "", hidden).when(parent != "", parent).otherwise("root")
    rows = sections.withColumn("directory", bucket).withColumn("file", X.file_name("file_path"))
    tags = rows.select("directory", "ord", F.explode("tags").alias("tag")).groupBy("directory").agg(scan.first_distinct("tag", 8).alias("top_tags"))
    out = rows.groupBy("directory").agg(F.countDistinct("file_path").alias("docs"), F.count("*").alias("sections"), F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("file_list"), scan.first_distinct("heading", 3, F.col("level") <= 1).alias("titles"))
    return out.join(tags, "directory", "left").fillna("", ["top_tags"])


def context(sections: DataFrame, links: DataFrame, frontmatters: DataFrame, file: str) -> DataFrame:
    """A row for each file that answers to a name: front matter, sections, links in and out (raw ones marked)."""
    rows = sections.filter(X.match_file("file_path", file))
    per = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "heading", "level", "start_line", "summary", "word_count", "link_count"))).alias("sections"))
    into = links.filter(F.col("target_resolved").isNotNull()).groupBy(F.col("target_resolved").alias("file_path")).agg(F.collect_list(F.struct("source_file", "source_heading", "link_text")).alias("backlinks"))
    out = links.groupBy(F.col("source_file").alias("file_path")).agg(F.collect_list(F.struct(F.coalesce("target_resolved", F.concat(F.lit("⚠ "), "target_path")).alias("to"), "link_text", "source_heading")).alias("outlinks"))
    meta = frontmatters.select("file_path", "title", "status", F.col("tags").alias("file_tags"), "related")
    n = F.count("*").over(Window.partitionBy(F.lit(1)))  # the few files that answer to the name
    return per.join(meta, "file_path", "left").join(into, "file_path", "left").join(out, "file_path", "left").withColumn("error", F.when(n > 1, "several files answer"))


def expand(sections: DataFrame, links: DataFrame, chunk: str) -> DataFrame:
    into = links.filter(F.col("target_resolved").isNotNull()).groupBy(F.col("target_resolved").alias("file_path")).agg(F.array_sort(F.collect_set(F.concat_ws(" :: ", "source_file", "source_heading"))).alias("backlinks"))
    return sections.filter(F.col("chunk_id") == chunk).join(into, "file_path", "left")


def files(sections: DataFrame, links: DataFrame, frontmatters: DataFrame, pattern: str | None = None) -> DataFrame:
    rows = scan.grouped_files(sections, pattern, glob_on_name=False).groupBy("file_path").agg(F.count("*").alias("sections"), F.sum("word_count").cast("long").alias("words"))
    n = links.filter(F.col("target_resolved").isNotNull()).groupBy(F.col("target_resolved").alias("file_path")).agg(F.count("*").alias("backlinks"))
    meta = frontmatters.select("file_path", "title", F.array_join("tags", ", ").alias("tags"))
    return rows.join(n, "file_path", "left").join(meta, "file_path", "left").fillna(0, ["backlinks"]).withColumn("file", X.file_name("file_path"))


def backlinks(links: DataFrame, file: str) -> DataFrame:
    """Links whose target, resolved or as written, answers to a name."""
    hit = F.coalesce(X.match_file("target_resolved", file), F.lit(False)) | X.match_file("target_path", file)
    return links.filter(hit).select(F.col("source_file").alias("from"), F.col("source_heading").alias("section"), F.col("link_text").alias("text"), "line", F.when(F.col("target_resolved").isNotNull(), "✓").otherwise("✗").alias("resolved"))


def links_of(links: DataFrame, file: str) -> DataFrame:
    return links.filter(X.match_file("source_file", file)).select(F.coalesce("target_resolved", "target_path").alias("to"), F.col("link_text").alias("text"), F.col("source_heading").alias("section"), "line")


def orphans(sections: DataFrame, links: DataFrame) -> DataFrame:
    """Files that no link resolves to."""
    rows = sections.groupBy("file_path").agg(F.count("*").alias("sections"))
    return rows.join(links.filter(F.col("target_resolved").isNotNull()).select(F.col("target_resolved").alias("file_path")).distinct(), "file_path", "left_anti")


def broken(links: DataFrame) -> DataFrame:
    return links.filter(F.col("target_resolved").isNull()).select(F.col("source_file").alias("from"), F.col("target_path").alias("target"), F.col("link_text").alias("text"), F.col("source_heading").alias("section"), "line")


def placement(vectors: DataFrame, vector: list[float], limit: int = 3, column: str = "emb") -> DataFrame:
    """Files in which a text would stand well: of the 3 * limit nearest sections, by file, the mean score and the best section."""
    near = V.top(V.scored(vectors, column, vector), 3 * limit)
    by = near.groupBy("file_path").agg(F.avg("score").alias("score"), F.max_by(F.struct("heading", "heading_path"), F.struct("score", -F.col("ord"))).alias("b"))
    return by.orderBy(F.desc("score"), "file_path").limit(limit).select("file_path", X.rounded("score").alias("score"), F.col("b.heading").alias("near_section"), F.col("b.heading_path").alias("section_path"))


def novelty_status(score, signal, threshold: float = 0.75):
    """off-topic, musing, covered or novel."""
    return F.when(score < 0.5, "off-topic").when((signal < 0) | ((signal < 1) & (score < 0.6)), "musing").when(score >= threshold, "covered").otherwise("novel")


def novelty(texts: DataFrame, vectors: DataFrame, threshold: float = 0.75) -> DataFrame:
    """texts (paragraph, emb): each paragraph's nearest section and whether it is new. vectors (file_path, heading, emb, ord).

    All paragraphs are compared with all sections in blocks, by matrix products; only each paragraph's best section of a shard is kept.
    """
    q = cut(texts.select("paragraph", F.col("emb").cast("array<double>").alias("asked")).withColumn("_k", F.monotonically_increasing_id()))
    rows = vectors.withColumn("ord", F.col("ord").cast("long"))
    near = nearest(q.select(F.col("_k").alias("id"), "asked"), rows.select("ord", F.col("emb").cast("array<double>").alias("emb")))
    best = near.join(rows.select("ord", "file_path", "heading"), "ord").select(F.col("id").alias("_k"), F.struct("file_path", "heading", "score").alias("b"))
    out = q.join(best, "_k", "left").withColumn("signal", X.knowledge_signal("paragraph"))
    score = F.coalesce("b.score", F.lit(0.0))
    return out.select(F.when(F.length("paragraph") > 120, F.concat(F.substring("paragraph", 1, 120), F.lit("..."))).otherwise(F.col("paragraph")).alias("paragraph"), novelty_status(score, F.col("signal"), threshold).alias("status"), X.rounded(score).alias("score"), "signal", X.file_name(F.col("b.file_path")).alias("near_doc"), F.col("b.heading").alias("near_section"))


def paragraph_rows(texts: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumn("paragraph", F.explode(paragraphs(column)))


def walk(links: DataFrame, file: str, depth: int = 2, direction: str = "out") -> DataFrame:
    """Along resolved links, or against them, depth first: (hop, src, path, via, trail).

    A file is entered once, and none once depth * 10 rows are found; every file that an entered one leads to, and that wasn't entered before
    it, is a row. Which files are entered depends on the first links of each only, so that all of them never meet in one task.
    """
    spark = links.sparkSession
    most = depth * 10
    a, b = ("source_file", "target_resolved") if direction == "out" else ("target_resolved", "source_file")
    edges = links.filter(F.col("target_resolved").isNotNull()).groupBy(F.col(a).alias("src"), F.col(b).alias("dst")).agg(F.min(F.struct("line", "link_text")).alias("l"))
    edges = edges.select("src", "dst", F.col("l.line").alias("ord"), F.col("l.link_text").alias("via"))

    def told(path: Column, via: Column) -> Column:
        return F.concat(X.file_name(path), F.lit(" ("), via, F.lit(")"))

    def hop(frontier: DataFrame, k: int) -> DataFrame:
        # Those entered before are left out, and they are `most` and one at most.
        near = graph.first_of(edges.join(frontier, "src", "left_semi"), 2 * most + 2)
        return near.select("src", "ord", "dst", F.col("dst").alias("next"), told(F.col("dst"), F.col("via")).alias("said"))

    start = spark.createDataFrame([(file,)], "src string")
    first = graph.reached(start, depth, hop)
    entered = graph.depth_first(first, start.withColumn("said", X.file_name("src")), depth, most, unseen=True).filter("dst is null").select("src", "hop", "trail", "met")
    rows = edges.join(entered, "src").filter(~F.expr("array_contains(met, dst)"))
    return rows.select("hop", "src", F.col("dst").alias("path"), "via", F.concat("trail", F.lit(" → "), told(F.col("dst"), F.col("via"))).alias("trail"))


def entity_rows(source: DataFrame) -> DataFrame:
    """(entity, file_path): what each row's text names. source (file_path, content)."""
    return source.select("file_path", F.explode(X.entity_refs("content")).alias("entity"))


def entity_table(named: DataFrame, files: DataFrame, sample: int | None = None) -> DataFrame:
    """By entity: how many files name it, its signal and importance, and their names, or the first `sample` of them.

    named (entity, file_path), files (file_path). With `sample`, no more than so many names of an entity are ever held together.
    """
    total = files.agg(F.countDistinct("file_path").alias("total_files"))
    stems = files.select(F.lower(X.file_stem("file_path")).alias("_stem")).distinct()
    names = named.select("entity", X.file_stem("file_path").alias("file")).distinct()
    shown = F.col("file")
    if sample is not None:
        names = names.withColumn("_k", F.row_number().over(Window.partitionBy("entity").orderBy("file")))
        shown = F.when(F.col("_k") <= sample, F.col("file"))
    # One pass: who doesn't ask for the names pays nothing for them.
    out = names.groupBy("entity").agg(F.count("*").alias("count"), F.array_join(F.array_sort(F.collect_list(shown)), ", ").alias("sources"))
    out = out.join(stems, F.col("entity") == F.col("_stem"), "left").join(F.broadcast(total), F.lit(True))  # one row
    god = F.greatest(F.lit(5), F.ceil(F.col("total_files") * 0.05))
    out = out.withColumn("signal", F.when(F.col("count") >= god, "god-node").when(F.col("count") >= 2, "shared").otherwise("isolated"))
    out = out.withColumn("importance", X.entity_importance("entity", F.col("_stem").isNotNull()))
    return out.select("entity", "sources", "count", "total_files", "signal", "importance")


def in_entity_scope(scope: str):
    """Is the entity the scope, below it or above it?"""
    wanted = X.normalize_entity(F.lit(scope))
    return (F.col("entity") == wanted) | F.col("entity").startswith(F.concat(wanted, F.lit("."))) | F.startswith(wanted, F.concat("entity", F.lit(".")))


def gaps(source: DataFrame, scope: str = "", min_docs: int = 1, signal: str = "") -> DataFrame:
    """Entities by the files that name them: god-nodes first, then shared, then isolated ones; the most named, most important first.
    source (file_path, content)."""
    named = entity_rows(source)
    files = cut(source.select("file_path").distinct())  # asked for twice, without the texts
    out = entity_table(named.filter(in_entity_scope(scope)) if scope else named, files).filter(F.col("count") >= min_docs)
    out = out if not signal else out.filter(F.col("signal") == signal)
    kind = F.when(F.col("signal") == "god-node", 0).when(F.col("signal") == "shared", 1).otherwise(2)
    return out.orderBy(kind, F.desc("count"), F.desc("importance"), "entity")


def gaps_note(source: DataFrame, scope: str = "", min_docs: int = 1, signal: str = "") -> DataFrame:
    """Why gaps() is empty, in one row (note, total_entities, total_files); no row where it isn't."""
    named = entity_rows(source)
    every = entity_table(named, source)
    here = every.filter(in_entity_scope(scope)) if scope else every
    fits = F.col("count") >= min_docs
    fits = fits & (F.col("signal") == signal) if signal else fits
    seen = here.agg(F.count("*").alias("matched"), F.coalesce(F.max(fits), F.lit(False)).alias("any"), F.array_join(F.array_sort(F.collect_set("signal")), ", ").alias("signals"))
    of = named.agg(F.countDistinct("entity").alias("total_entities")).join(F.broadcast(source.agg(F.countDistinct("file_path").alias("total_files"))), F.lit(True))
    none = F.lit("No cross-document entity references found.")
    note = none
    if signal:
        note = F.format_string(f"No entities with signal '{signal}' found (minDocs={min_docs}). The index has %d entities across %d files.", "total_entities", "total_files")
    if scope and signal:
        note = F.format_string(f"Scope '{scope}' matched %d entities, but none have signal '{signal}'. Found signals: %s. Try gaps({{scope: '{scope}'}}) without signal filter.", "matched", "signals")
    if scope:
        lost = F.format_string(f"No entities matching scope '{scope}' found. The index has %d entities across %d files. Scope uses exact/prefix matching on normalized (lowercase) names — try a shorter prefix or gaps() with no scope to see available entities.", "total_entities", "total_files")
        note = F.when(F.col("matched") == 0, lost).otherwise(note)
    return of.join(F.broadcast(seen), F.lit(True)).filter(~F.col("any")).select(note.alias("note"), "total_entities", "total_files")  # one row on either side


#: Vectors that are settled at a time, about how many of a folder meet the centres in one task, and how many of those are multiplied at a time.
LEADERS, SHARD, STEP = 8192, 4096, 256
#: Fewer documents than these aren't split.
FEWEST = 4


def _unit(rows) -> "np.ndarray":  # noqa: F821
    """Vectors of length one; zeros stay, and so are near nothing."""
    import numpy as np

    m = np.array([np.asarray(v, dtype=np.float64) for v in rows["emb"]])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _settled(threshold: float):
    """Of a block in its order: those that no earlier centre of the block is near to."""
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ord", "file_path"])
        m = _unit(rows)
        covered, centres = np.zeros(len(m), bool), []
        for i in range(len(m)):
            if not covered[i]:
                centres.append(i)
                covered |= m @ m[i] >= threshold
        return rows.iloc[centres]

    return run


def _uncovered(threshold: float):
    import numpy as np
    import pandas as pd

    def run(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 0 or len(centres) == 0:
            return rows
        m, c = _unit(rows), _unit(centres).T
        return rows[np.concatenate([(m[i : i + STEP] @ c).max(axis=1) for i in range(0, len(m), STEP)]) < threshold]

    return run


def _nearest(rows, centres):
    """Each row with the nearest of the centres that come before it or are itself: the first of equally near ones."""
    import numpy as np
    import pandas as pd

    if len(rows) == 0 or len(centres) == 0:
        return pd.DataFrame({"directory": [], "file_path": [], "sim": [], "cluster": []})
    # Clusters are numbered in the order of their centres, so that those before a row are the first ones.
    centres = centres.sort_values("cluster")
    place = pd.concat([x[["ord", "file_path"]] for x in (centres, rows)], ignore_index=True).groupby(["ord", "file_path"]).ngroup().to_numpy()
    of_centre, of_row = place[: len(centres)], place[len(centres) :]
    before = np.searchsorted(of_centre, of_row)
    own = np.where(of_centre[np.minimum(before, len(centres) - 1)] == of_row, np.minimum(before, len(centres) - 1), -1)
    m, c = _unit(rows), _unit(centres).T
    best, most = np.zeros(len(m), np.int64), np.zeros(len(m))
    for i in range(0, len(m), STEP):
        sim = m[i : i + STEP] @ c
        at = np.arange(len(sim))
        sim[np.arange(len(centres))[None, :] >= before[i : i + STEP, None]] = -9.0
        mine = own[i : i + STEP]
        sim[at[mine >= 0], mine[mine >= 0]] = 9.0
        best[i : i + STEP] = sim.argmax(axis=1)
        most[i : i + STEP] = sim[at, best[i : i + STEP]]
    return pd.DataFrame({"directory": rows["directory"].to_numpy(), "file_path": rows["file_path"].to_numpy(), "sim": most, "cluster": centres["cluster"].to_numpy()[best]})


def cluster(vectors: DataFrame, threshold: float = 0.7) -> DataFrame:
    """vectors (directory, file_path, emb, ord), a row for each file, of one length: (directory, file_path, cluster, suggestion).

    In order, a file joins the nearest centre at `threshold` or more, or is a centre itself. Folders of fewer than four files, or of
    fewer than four with vectors, aren't split: one row says so.

    Whether a file is a centre depends on earlier centres alone. So the first LEADERS open files of each folder are settled among
    themselves in order, those that a new centre is near to are taken out everywhere, and so on until none is open; then each file looks for its
    nearest earlier centre. Both are matrix products of a shard of a folder with LEADERS centres at most; rounds are tables in the checkpoint folder.
    """
    rows = vectors.select("directory", "file_path", F.col("ord").cast("long").alias("ord"), "emb")
    n = rows.groupBy("directory").agg(F.count("*").alias("docs"), F.count_if(F.coalesce(F.size("emb"), F.lit(0)) > 0).alias("embedded"))
    few = n.filter((F.col("docs") < FEWEST) | (F.col("embedded") < FEWEST))
    said = F.when(F.col("docs") < FEWEST, f"Folder has fewer than {FEWEST} docs — no split needed.").otherwise("Not enough embedded docs to cluster.")
    told = few.select("directory", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("cluster"), said.alias("suggestion"))

    many = n.filter((F.col("docs") >= FEWEST) & (F.col("embedded") >= FEWEST)).select("directory", F.ceil(F.col("embedded") / SHARD).alias("shards"))
    schema = "directory string, file_path string, ord long, emb array<double>, shard int"
    shard = F.pmod(F.xxhash64("file_path"), F.col("shards")).cast("int")
    rows = cut(rows.filter(F.size("emb") > 0).join(many, "directory").select("directory", "file_path", "ord", F.col("emb").cast("array<double>").alias("emb"), shard.alias("shard")))
    shards = rows.select(F.col("directory").alias("of"), F.col("shard").alias("part")).distinct()

    def everywhere(centres: DataFrame) -> DataFrame:
        return centres.join(shards, F.col("directory") == F.col("of")).drop("directory", "shard")

    left, centres = rows, None
    while not left.isEmpty():
        order = Window.partitionBy("directory").orderBy("ord", "file_path")
        block = left.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= LEADERS).drop("_k")
        found = cut(block.groupBy("directory").applyInPandas(_settled(threshold), schema))
        centres = found if centres is None else centres.union(found)
        last = block.groupBy("directory").agg(F.max(F.struct("ord", "file_path")).alias("_last"))
        rest = left.join(last, "directory").filter(F.struct("ord", "file_path") > F.col("_last")).drop("_last")
        left = cut(rest.groupBy("directory", "shard").cogroup(everywhere(found).groupBy("of", "part")).applyInPandas(_uncovered(threshold), schema))
    if centres is None:
        return told
    numbered = centres.withColumn("cluster", (F.row_number().over(Window.partitionBy("directory").orderBy("ord", "file_path")) - 1).cast("int"))
    numbered = everywhere(numbered).withColumn("of_block", F.floor(F.col("cluster") / LEADERS).cast("int"))
    blocks = numbered.groupBy("of").agg(F.max("of_block").alias("blocks"))
    spread = rows.join(blocks, F.col("directory") == F.col("of")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks")))).drop("of", "blocks")
    near = spread.groupBy("directory", "shard", "block").cogroup(numbered.groupBy("of", "part", "of_block")).applyInPandas(_nearest, "directory string, file_path string, sim double, cluster int")
    best = near.groupBy("directory", "file_path").agg(F.max_by("cluster", F.struct("sim", -F.col("cluster"))).alias("cluster"))
    return best.select("directory", "file_path", "cluster", F.lit(None).cast("string").alias("suggestion")).unionByName(told)


def suggested_folders(clusters: DataFrame) -> DataFrame:
    """A name for each cluster of two or more: the two most frequent words of its file names."""
    clusters = clusters.filter("cluster is not null")
    words = clusters.select("directory", "cluster", F.explode(F.split(F.lower(X.file_stem("file_path")), r"[^\p{L}]+")).alias("w")).filter(F.length("w") > 2)
    n = words.groupBy("directory", "cluster", "w").count()
    by = Window.partitionBy("directory", "cluster").orderBy(F.desc("count"), "w")
    name = n.withColumn("_k", F.row_number().over(by)).filter("_k <= 2").groupBy("directory", "cluster").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_k", "w")))["w"], "-").alias("suggested_folder"))
    out = clusters.groupBy("directory", "cluster").agg(F.count("*").alias("docs"), F.array_join(F.array_sort(F.collect_list(X.file_name("file_path"))), ", ").alias("files")).filter("docs > 1")
    return out.join(name, ["directory", "cluster"], "left")


def stale(frontmatters: DataFrame, mtimes: DataFrame, mentioned: DataFrame, days: float = 1.0) -> DataFrame:
    """Documents older than what they name. mtimes (file_path, modified); mentioned (file_path, target): code files in the text.

    Related paths of the front matter count when newer at all, mentioned code files when newer by more than `days`.
    """
    related = frontmatters.select("file_path", F.explode("related").alias("target"), F.lit(0.0).alias("slack"))
    named = related.union(mentioned.select("file_path", "target", F.lit(days).alias("slack")))
    doc = mtimes.select("file_path", F.col("modified").alias("doc_modified"))
    target = mtimes.select(X.file_name("file_path").alias("_name"), F.col("file_path").alias("target_file"), F.col("modified").alias("target_modified"))
    out = named.join(doc, "file_path").join(target, X.file_name("target") == F.col("_name")).filter(X.match_file("target_file", F.col("target")))
    newer = (F.unix_micros("target_modified") - F.unix_micros("doc_modified")) / 86_400_000_000
    return out.withColumn("days_newer", newer).filter(F.col("days_newer") > F.col("slack")).select("file_path", "target_file", "days_newer").distinct()
