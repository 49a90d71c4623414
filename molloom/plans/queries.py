"""The registered queries of the library: each applies an operator to whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molloom.functions import fingerprints as fp
from molloom.operators import enumerate as en
from molloom.operators import cluster, count_sets, filters, patterns, popcount_index, profile, selection, set_walk, similarity, store, transform
from molloom.operators import neighbour_graph as graphs
from molloom.plans import enumeration
from molloom.sources import schemes

REGISTERED: dict = {}


def query(f):
    REGISTERED[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def words_of(spark, sf) -> DataFrame:
    """embeddings as 64-bit fingerprints: (vec_id, label, word)."""
    return read(spark, sf, "embeddings").select("vec_id", "label", fp.sign_word(F.col("embedding")).alias("word"))


def scored(spark, sf) -> DataFrame:
    """Every vector beside every query (ids divisible by 100): Tanimoto t and the counts behind it."""
    all_ = words_of(spark, sf)
    queries = all_.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"), F.col("word").alias("qword"))
    both = similarity.against_queries(all_, queries)
    common = F.bit_count(F.col("word").bitwiseAND(F.col("qword")))
    return both.select("q", "vec_id", "label", common.alias("c"), F.bit_count("qword").alias("a"), F.bit_count("word").alias("n"), fp.tanimoto_words(F.col("word"), F.col("qword")).alias("t"))


@query
def top_k_tanimoto(spark, sf):
    """The three most similar vectors of each query."""
    s = scored(spark, sf).withColumn("score", F.round("t", 6))
    return similarity.top_k(s, "q", "score", "vec_id", 3).select("q", "vec_id", "score", "rank")


@query
def indexed_top_k(spark, sf):
    """The same over an index stored by population count, which is read from each query's own count outwards."""
    words = words_of(spark, sf)
    queries = words.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"), F.array("word").alias("words"))
    found, _ = popcount_index.search(popcount_index.build(words, "vec_id", "word"), queries, 3)
    return found.select("q", F.col("row").alias("vec_id"), "score", "rank")


@query
def tanimoto_pairs(spark, sf):
    """The rounded score of every vector with every query."""
    return scored(spark, sf).select("q", "vec_id", F.round("t", 2).alias("score"))


@query
def similarity_matrix(spark, sf):
    """Scores of each vector to all queries side by side, as text in query order."""
    words = words_of(spark, sf)
    return similarity.score_rows(words, words.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("q"), F.col("word").alias("qword")))


@query
def tversky_probe_report(spark, sf):
    """Vectors that contain a probe for more than .6, with list, number and best of the probes."""
    s = scored(spark, sf).withColumn("score", F.round(fp.tversky(F.col("c"), F.col("a"), F.col("n")), 2))
    return similarity.probe_report(s, "vec_id", "q", "score", 0.6)


@query
def closest_list(spark, sf):
    """A10: for each label the mean over queries of the best score."""
    return similarity.closest_list(scored(spark, sf), "label", "q", "t").select("label", F.round("mean_best", 6).alias("mean_best"), "n_probes")


@query
def query_neighbour_counts(spark, sf):
    """Vectors with a score above .5 for each query, itself included."""
    return scored(spark, sf).groupBy("q").agg(F.count_if(F.col("t") > 0.5).alias("n_similar"), F.round(F.avg("t"), 6).alias("mean_score"))


@query
def knn_graph(spark, sf):
    """U1, as a search: the 25 nearest vectors of each query. neighbour_graph has those of all vectors."""
    s = scored(spark, sf).withColumn("score", F.round("t", 6))
    return profile.knn_graph(s, "q", "vec_id", "score").select("q", "vec_id", "score", "n")


@query
def neighbour_graph(spark, sf):
    """The 25 nearest of every fingerprint, by neighbours of neighbours; vectors with one fingerprint share them."""
    points, members = graphs.points_of(words_of(spark, sf), "vec_id", "word")
    near = graphs.neighbour_graph(points)[0]
    return members.join(near.hint("merge"), "point").select(F.col("row").alias("vec_id"), "point", "near", F.round("score", 6).alias("score"))


@query
def count_tanimoto_neighbours(spark, sf):
    """Of each document its class of equal word counts, and other classes with a count Tanimoto of .8 or more."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("row"), F.split(F.lower(F.coalesce("text", F.lit(""))), " ").alias("tokens"))
    linked, rows = count_sets.count_links(docs, 0.8)
    return similarity.neighbour_counts(linked, rows).select(F.col("row").alias("doc_id"), "class_id", "n_links")


@query
def neighbours_at_the_cutoff(spark, sf):
    """Brands that suppliers sell in large lots, and all brands (supplier -1): classes, and classes at a Jaccard of .56 or more,
    which 14 of 25 brands meet exactly."""
    items = read(spark, sf, "lineitem").where("l_quantity > 47").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sold = items.groupBy(F.col("l_suppkey").alias("row")).agg(F.collect_set("p_brand").alias("brands"))
    every = read(spark, sf, "part").groupBy(F.lit(-1).cast("long").alias("row")).agg(F.collect_set("p_brand").alias("brands"))
    reps, rows = similarity.classes(sold.unionByName(every), "row", "brands")
    return similarity.neighbour_counts(similarity.linked_counts(reps, 0.56), rows).select(F.col("row").alias("l_suppkey"), "class_id", "n_links")


def sparse_prints(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), fp.largest_places(F.transform("embedding", lambda x: F.abs(x)), 8).alias("bits"))


@query
def sphere_exclusion(spark, sf):
    """Directed sphere exclusion over vectors from the largest id down, Tanimoto .45 on their 8 largest places."""
    none = F.array().cast("array<int>").alias("blocks")
    rows = sparse_prints(spark, sf).select("row", (-F.col("row")).alias("rank"), none, F.lit(False).alias("failed"), F.col("bits").alias("places"))
    return set_walk.walk_over_sets(rows, 64, 0.45).select(F.col("row").alias("vec_id"), "reason")


@query
def diverse_walk(spark, sf):
    """D1, joint rules: one vector of each set of 8 largest places, from the largest id down; two similar ones (Tanimoto .25)
    or one beyond .45 reject it, and 30 of a label are chosen at most."""
    member = sparse_prints(spark, sf).groupBy("bits").agg(F.max("row").alias("row"))
    labelled = read(spark, sf, "embeddings").select(F.col("vec_id").alias("of_row"), F.array("label").alias("blocks"))
    rows = member.join(labelled, F.col("row") == F.col("of_row")).select("row", (-F.col("row")).alias("rank"), "blocks", F.lit(False).alias("failed"), F.col("bits").alias("places"))
    out = set_walk.walk_over_sets(rows, 64, 0.25, hard=0.45, cap=30, max_sim=2)
    return out.select(F.col("row").alias("vec_id"), "reason", "group")


@query
def usage_cap(spark, sf):
    """At most two orders of each customer, the dearest first."""
    o = read(spark, sf, "orders")
    out = selection.usage_cap(o, "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2)
    return out.select("o_orderkey", "reason")


@query
def scaffold_groups(spark, sf):
    """A1: each part with the size and the first part of its type."""
    return selection.group_members(read(spark, sf, "part"), "p_type", "p_partkey")


@query
def choose_compounds(spark, sf):
    """One part of each brand: of priority size if any, else of the brand's most frequent type."""
    part = read(spark, sf, "part")
    common = part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("p_type").alias("t"))).alias("s")).select("p_brand", F.col("s.t").alias("main_type"))
    out = selection.choose_one(part.join(common, "p_brand"), "p_brand", F.col("p_size") == 7, F.col("p_type") == F.col("main_type"), "p_partkey")
    return out.select("p_brand", "p_partkey", "p_type", "p_size")


@query
def cluster_extremes(spark, sf):
    """A8."""
    return profile.extremes(read(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query
def cluster_medoids(spark, sf):
    """The vector nearest to the mean of each label."""
    return profile.medoids(read(spark, sf, "embeddings"), "label", "vec_id", "embedding").select("label", "medoid")


LIMITS = {"MW_high": 990.0, "MW_low": 910.0, "HBD_high": 40.0, "HBD_low": 3.0}
AS_PART = {"mw": "p_retailprice", "hbd": "p_size"}


@query
def property_filter_stats(spark, sf):
    """Parts by the first bound they break."""
    return filters.filter_stats(read(spark, sf, "part"), filters.first_failure(LIMITS, AS_PART))


@query
def kept_and_removed(spark, sf):
    """Whether each part is removed by properties or by name patterns, and the pattern."""
    part = read(spark, sf, "part")
    failure, pattern = filters.first_failure(LIMITS, AS_PART), filters.first_pattern(F.col("p_name"), ["e$", "^a", "1"])
    return part.select("p_partkey", filters.removed(failure.isNotNull(), pattern.isNotNull()).alias("removed"), failure.alias("first_fail"), pattern.alias("pattern"))


@query
def substructure_counts(spark, sf):
    """Documents by the first of some patterns that they hold."""
    p = filters.first_pattern(F.col("text"), ["[0-9]{4}", "!!", "the", "que"])
    return read(spark, sf, "documents").groupBy(p.alias("pattern")).agg(F.count("*").alias("n"))


@query
def pattern_table(spark, sf):
    """Every long word of the benchmark as a pattern: documents that hold it, and those of which it is the first."""
    words = read(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("pattern")).where(F.col("pattern").rlike("^[a-z]{6,}$")).distinct()
    table = transform.number_rows(words, [F.col("pattern")], "number")
    docs = read(spark, sf, "documents").select("doc_id", "text")
    found = store.kept(patterns.matches(docs, table, "doc_id"))
    first = found.groupBy("key").agg(F.min("number").alias("number")).groupBy(F.col("number").alias("of")).agg(F.count("*").alias("n_first"))
    every = found.groupBy("number").agg(F.count("*").alias("n_texts")).join(first, F.col("number") == F.col("of"), "left")
    return table.join(every, "number").select("pattern", "n_texts", F.coalesce("n_first", F.lit(0)).cast("long").alias("n_first"))


@query
def pattern_groups(spark, sf):
    """documents that hold one of two words and a third and none of the excluded."""
    keep = filters.pattern_groups(F.col("text"), [["the", "que"], "an"], ["[0-9]", "!!"])
    return read(spark, sf, "documents").where(keep).select("doc_id", "lang")


@query
def named_block_lists(spark, sf):
    """Parts by the named lists whose patterns they meet; one list has two names."""
    specs = {"round": {"include": [["o", "a"], "e"], "exclude": ["^s"]}, "plain": {"exclude": ["[aeiou]{2}", "x"]}, "none": {"include": ["qqq"]}}
    out = filters.named_lists(read(spark, sf, "part"), "p_name", specs, {"round": ["BB1", "BB2"], "plain": "BB3"})
    return out.groupBy("list").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query
def nearest_but_excluded(spark, sf):
    """The three most similar vectors of each query that are not on the list of excluded ones, with their label."""
    s = scored(spark, sf).withColumn("score", F.round("t", 6))
    gone = read(spark, sf, "embeddings").where("vec_id % 3 = 0").select("vec_id")
    return similarity.top_k_but(s, gone, "q", "score", "vec_id", 3).select("q", "vec_id", "label", "score", "rank")


@query
def mass_cutoff(spark, sf):
    """Parts up to a price, of listed brands and with a type."""
    part = read(spark, sf, "part")
    brands = part.where("p_size > 45").select("p_brand").distinct()
    return filters.drop_failures(part.where("p_retailprice <= 960"), "p_type").join(brands, "p_brand", "left_semi").select("p_partkey", "p_brand")


@query
def exclusion_list(spark, sf):
    """Parts that are not on the list of large ones."""
    part = read(spark, sf, "part")
    return filters.exclude_ids(part, part.where("p_size > 40"), "p_partkey").select("p_partkey", "p_size")


def blocks(spark, sf) -> DataFrame:
    """Building-block lists of three cycles: the distinct brands, types and sizes of parts."""
    part = read(spark, sf, "part")
    each = {"BB1": "p_brand", "BB2": "p_type", "BB3": "p_size"}
    return transform.union_all([part.select(F.lit(c).alias("cycle"), F.col(x).cast("string").alias("bb_id")).distinct() for c, x in each.items()])


@query
def library_size(spark, sf):
    """A5, E7 (count only)."""
    return en.library_size(blocks(spark, sf))


@query
def cycle_sizes(spark, sf):
    """A4: the cycles with their sizes."""
    return blocks(spark, sf).groupBy("cycle").agg(F.count("*").alias("n")).orderBy("cycle")


@query
def full_product(spark, sf):
    """All products of three cycles, as counts of each pair's products by length."""
    b = blocks(spark, sf)
    lists = [b.where(F.col("cycle") == c).select(F.col("bb_id").alias(f"bb{k}")) for k, c in enumerate(("BB1", "BB2", "BB3"), 1)]
    product = en.full_product(lists).withColumn("full", F.concat_ws(".", "bb1", "bb2", "bb3"))
    return product.groupBy("bb1", "bb2").agg(F.count("*").alias("n"), F.min("full").alias("first"), F.sum(F.length("full")).cast("long").alias("letters"))


@query
def sampled_product(spark, sf):
    """500 distinct members of the product, decoded from their numbers."""
    b = en.positions(blocks(spark, sf))
    return en.sample_product(b, ["BB1", "BB2", "BB3"], 500)


@query
def memoised_lookup(spark, sf):
    """A value of each (part, supplier), computed once and joined back to all lines."""
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = en.lookup_distinct(items, ["l_partkey", "l_suppkey"], "product", F.concat_ws(".", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    return out.select("l_orderkey", "l_linenumber", "product")


@query
def lookup_with_nulls(spark, sf):
    """The same where keys are null: a value of each (discount, part) with nulls for the discount 0."""
    items = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr("nullif(l_discount, 0)").alias("d"), "l_returnflag")
    out = en.lookup_distinct(items, ["d", "l_returnflag"], "product", F.concat_ws(".", F.round(F.col("d") * 100).cast("int").cast("string"), "l_returnflag"))
    return out.select("l_orderkey", "l_linenumber", "product")


@query
def picklist_join(spark, sf):
    """Customers with their large orders, or none."""
    picks = read(spark, sf, "customer").select(F.col("c_custkey").alias("bb_id"))
    own = read(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("bb_id"), "o_orderkey")
    return en.picklist(own, picks, "bb_id")


@query
def directory_union(spark, sf):
    """The lists of customers and suppliers as one, incomplete rows dropped."""
    c = read(spark, sf, "customer").selectExpr("c_custkey AS bb_id", "c_name AS smiles")
    s = read(spark, sf, "supplier").selectExpr("s_suppkey AS bb_id", "s_name AS smiles")
    return transform.union_all([c, s])


@query
def keep_first_product(spark, sf):
    """Of parts with one name the first."""
    return en.keep_first(read(spark, sf, "part"), ["p_name"], "p_partkey").select("p_name", "p_partkey")


def scheme(df: DataFrame) -> DataFrame:
    p, size = F.col("product"), F.col("p_size")
    steps: list[list[tuple[Column | None, Column | str]]] = [
        [(size > 40, F.concat(p, F.lit("+a"))), (size > 20, F.concat(F.lit("b("), p, F.lit(")"))), (size > 3, en.SKIP)],
        [(p.startswith("b("), en.STOP), (F.col("p_retailprice") > 955, F.concat(p, F.lit("=c"))), (None, F.concat(p, F.lit("-d")))],
        [(p.endswith("c"), F.upper(p)), (size != 10, F.concat(p, F.lit("!")))],
    ]
    return en.run_scheme(df, F.col("p_brand"), steps)


@query
def reaction_scheme(spark, sf):
    """A scheme of three conditional steps over parts, with its intermediates."""
    out = scheme(read(spark, sf, "part"))
    return out.select("p_partkey", "product", "status", F.concat_ws(">", "intermediates").alias("trace"))


@query
def scheme_with_stops(spark, sf):
    """Rules before a STOP win over it, and a second STOP does not undo the first."""
    p, size = F.col("product"), F.col("p_size")
    steps = [[(size > 40, F.concat(p, F.lit("+a"))), (size > 30, en.STOP), (size > 20, F.concat(F.lit("b-"), p)), (None, en.STOP)], [(size == 45, en.STOP), (None, F.concat(p, F.lit("=c")))], [(None, F.concat(p, F.lit("!")))]]
    out = en.run_scheme(read(spark, sf, "part"), F.col("p_brand"), steps)
    return out.select("p_partkey", "product", "status", F.size("intermediates").alias("n_steps"))


#: A scheme in the JSON form: named and numbered reactants, ordered conditions, a named reaction, an end and skipped steps.
DEMO = r"""{"demo": {"reactants": ["brand", "kind", "size"], "steps": [
  {"Reactants": ["brand", "kind"], "Rxns": {"^S": "short", "^P": "terminate", "default": "^Brand(.*)\\.(.*)$>>$1-$2"}},
  {"Reactants": ["p", "r2"], "Rxns": {"^4": "product", "[05]$": ["never>>x", "^(.*)E\\.(.*)$>>$1:$2"], "default": "^(.*)\\.(.*)$>>$1/$2"}},
  {"Reactants": ["p", "None"], "Rxns": {"-": "-(?=[A-Z])>>_", "product": "product"}}]},
  "Named_Reactions": {"short": ["^Brand#1(.*)\\.(.*)$>>s$1.$2"]}}"""


@query
def scheme_products(spark, sf):
    """All products of three block lists by a scheme in JSON."""
    b = blocks(spark, sf).withColumn("smiles", F.col("bb_id"))
    named = schemes.named_reactions(schemes.load_named(DEMO))
    out = enumeration.enumerate_blocks(b, ["BB1", "BB2", "BB3"], schemes.load_scheme(DEMO, "demo"), named)
    return out.select("bb1", "bb2", "bb3", "full_smiles", "status", F.size("intermediates").alias("n_steps"))


@query
def status_split(spark, sf):
    """Products by status."""
    return scheme(read(spark, sf, "part")).groupBy("status").agg(F.count("*").alias("n"), F.count("product").alias("n_products"))


@query
def deprotection_variants(spark, sf):
    """The first and last variant of each turn, its words standing for variants."""
    c = read(spark, sf, "conversations")
    return en.variants(c, F.split(F.coalesce("text", F.lit("")), " "), first_and_last=True).select("conv_id", "turn", "n", "variant")


@query
def partner_sample(spark, sf):
    """Each brand beside the same 20 (type, size) partners."""
    part = read(spark, sf, "part")
    out = en.partner_sample(part.select("p_brand").distinct(), part.select("p_type", "p_size").distinct(), 20)
    return out.groupBy("p_brand").agg(F.count("*").alias("n_partners"), F.count_distinct("p_type", "p_size").alias("n_distinct"))


@query
def fragment_counts(spark, sf):
    """P6."""
    return read(spark, sf, "documents").select("doc_id", transform.fragment_count(F.col("text")).cast("long").alias("n_fragments"))


@query
def stripped_stereo(spark, sf):
    """Texts without stereo marks, as lengths."""
    return read(spark, sf, "pages").select("page_id", F.length(transform.strip_stereo(F.col("url"))).cast("long").alias("n_url"), F.length(transform.strip_stereo(F.col("html"))).cast("long").alias("n_html"))


@query
def standard_columns(spark, sf):
    """Aliased columns under their standard names."""
    return transform.standardize_columns(read(spark, sf, "orders"), {"id": ["o_orderkey", "order_id"], "rank": ["o_totalprice"]}).select("id", "rank")


@query
def property_histogram(spark, sf):
    """Parts by size and by price."""
    part = read(spark, sf, "part")
    size = profile.histogram(part, F.col("p_size").cast("double"), 0.0, 50.0, 11).withColumn("property", F.lit("size"))
    price = profile.histogram(part, F.col("p_retailprice"), 900.0, 1000.0, 21).withColumn("property", F.lit("price"))
    return size.unionByName(price)


@query
def colored_union(spark, sf):
    """Points of two tables with their colour."""
    c = read(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS x")
    s = read(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS x")
    return transform.tagged_union({"red": c, "blue": s}).groupBy("color").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("total"))


def started(spark, sf):
    """Vectors by label, and start centres: of each label the first 2 to 4 vectors."""
    points = cluster.points_of(read(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    w = Window.partitionBy("grp").orderBy("row")
    ranked = points.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 2 + F.col("grp").cast("int") % 3)
    return points, ranked.select("grp", F.lit(0).alias("start"), (F.col("n") - 1).cast("int").alias("cluster"), F.col("v").alias("centre"))


@query
def cycle_clusters(spark, sf):
    """The vectors of every label in clusters, after three iterations from given centres."""
    points, centres = started(spark, sf)
    out = cluster.assigned(points, cluster.lloyd(points, centres, 3)[0])
    return out.select(F.col("grp").cast("int").alias("label"), F.col("row").alias("vec_id"), F.col("cluster").alias("clustnum"), F.round(F.sqrt("d2"), 6).alias("distance"))


@query
def cycle_medoids(spark, sf):
    """Of each cluster's centre the nearest vector of the label."""
    points, centres = started(spark, sf)
    out = cluster.medoids(points, cluster.lloyd(points, centres, 3)[0])
    return out.select(F.col("grp").cast("int").alias("label"), F.col("cluster").alias("clustnum"), "medoid", "distance")


@query
def kmeans_clusters(spark, sf):
    """Clusters of the vectors of every label, three of each from drawn centres, and their sizes."""
    rows, _ = cluster.kmeans(read(spark, sf, "embeddings"), "label", "vec_id", "embedding", 3, starts=2, rounds=20)
    return rows.groupBy(F.col("grp").cast("int").alias("label"), "clustnum").agg(F.count("*").alias("n"))


@query
def chemical_space(spark, sf):
    """Vectors in two principal components."""
    return profile.embed(read(spark, sf, "embeddings"), "embedding").select("vec_id", "x", "y")


@query
def lsh_neighbours(spark, sf):
    """Approximate pairs of vectors with a Tanimoto of .3 or more on their 8 largest places."""
    return similarity.lsh_neighbours(sparse_prints(spark, sf), "row", "bits", 64, 0.3)
