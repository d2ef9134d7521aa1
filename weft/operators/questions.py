"""Q1-Q9: rules over questions(question_id, text), and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import array_at, cleaned, kind, object_in, text_at, texts_at
from ..functions.text import contains_any, no_blanks, strip
from .triples import mentions

#: Keywords of the intent rules and the relation hints, in rule order.
COUNT = ["多少", "几种", "数量", "有几"]
COMPARE = ["对比", "比较", "区别", "不同", "差异"]
PATH = ["怎么走", "路径", "如何通过", "发展为", "演变", "转变"]
PATH_HOW = ["导致", "引起", "发展", "形成", "产生"]
RELATION = ["关系", "关联", "有什么联系"]
ENTITY = ["哪些", "有哪些", "列出", "列举"]
HINTS = ["使用", "包含", "属于", "连接", "支持", "关联", "导致", "引起", "促进", "抑制", "损伤", "发展为", "诱发", "加剧", "缓解", "依赖", "影响"]
INTENTS = ["FIND_ENTITY", "FIND_RELATION", "FIND_PATH", "COUNT", "COMPARE", "EXPLAIN", "LIST"]
#: What splits a question into fragments, words that are no fragment, particles at a fragment's ends. Words of one
#: character are left out, as a fragment has two at least.
SPLIT = r"(?U)[？?！!。，,、；;：:\s]|如何|怎么|怎样|什么|为什么|通过|之间|发展为|导致|引起"
STOP = ["如何", "怎么", "怎样", "什么", "为什么", "是否", "是不是", "能否", "能不能", "可以", "通过", "之间", "有没有", "哪些", "多少", "有几", "有多少"]
LEAD, TAIL = "^[的了吗呢啊吧呀和与或及到在是将把被从对向为]", "[的了吗呢啊吧呀]$"
#: Names in Latin letters: acronyms, mixed case, X-1, G.709, measures.
LATIN = [r"[A-Z]{2,}(?:-[A-Z0-9]+)*", r"[A-Z][a-zA-Z]*[A-Z][a-zA-Z]*", r"[A-Z]{1,}[a-z]*-\d+", r"[A-Z]\.\d{2,}", r"\d+(?:\.\d+)?\s*(?:Gb/s|Mb/s|GHz|MHz|kHz|TB|GB|MB|KB)"]
QUOTES = "\"'“”‘’"


def intent(text: Column) -> Column:
    """Q1."""
    t = strip(text)
    path = contains_any(t, PATH) | (F.contains(t, F.lit("到")) & F.contains(t, F.lit("怎么"))) | (F.contains(t, F.lit("如何")) & contains_any(t, PATH_HOW))
    return F.when(t == "", "EXPLAIN").when(contains_any(t, COUNT), "COUNT").when(contains_any(t, COMPARE), "COMPARE").when(path, "FIND_PATH").when(contains_any(t, RELATION), "FIND_RELATION").when(contains_any(t, ENTITY), "FIND_ENTITY").otherwise("EXPLAIN")


def relation_hints(text: Column) -> Column:
    """Q2."""
    return F.filter(F.array(*map(F.lit, HINTS)), lambda k: F.contains(text, k))


def max_hops(text: Column) -> Column:
    """Q3: null without a constraint."""
    return F.regexp_extract(text, r"(\d+)跳", 1).try_cast("int")


def surface_entities(text: Column) -> Column:
    """Q4, the parts that need no names: quoted strings; and the Latin patterns."""
    quoted = F.regexp_extract_all(text, F.lit(f"[{QUOTES}]([^{QUOTES}]{{1,30}})[{QUOTES}]"), F.lit(1))
    latin = [F.regexp_extract_all(text, F.lit(f"(?<![A-Za-z0-9])(?:{p})(?![A-Za-z0-9])"), F.lit(0)) for p in LATIN]
    return F.struct(no_blanks(quoted).alias("quoted"), no_blanks(F.concat(*latin)).alias("latin"))


def fragments(text: Column) -> Column:
    """Q5."""
    kept = F.filter(F.transform(F.split(text, SPLIT), strip), lambda f: (F.length(f) >= 2) & ~f.isin(STOP))
    trimmed = F.transform(kept, lambda f: strip(F.regexp_replace(F.regexp_replace(f, LEAD, ""), TAIL, "")))
    return F.array_distinct(F.filter(trimmed, lambda f: F.length(f) >= 2))


def parse_rules(questions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Q1-Q5: (question_id, text, intent, entities, relation_hints, max_hops)."""
    q = questions.withColumn("text", F.coalesce("text", F.lit("")))
    if names is None:
        q = q.withColumn("known", F.array().cast("array<string>"))
    else:
        hit = mentions(q.select(F.col("question_id").alias("key"), F.col("text").alias("content")), names)
        known = hit.groupBy("key").agg(F.transform(F.sort_array(F.collect_set(F.struct((-F.length("name")).alias("l"), "name"))), lambda x: x["name"]).alias("known"))
        q = q.join(known.withColumnRenamed("key", "question_id"), "question_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    q = q.withColumn("s", surface_entities(F.col("text")))
    found = F.array_distinct(F.concat("s.quoted", "known", "s.latin"))
    return q.select("question_id", "text", intent(F.col("text")).alias("intent"), F.when(F.size(found) > 0, found).otherwise(fragments(F.col("text"))).alias("entities"), relation_hints(F.col("text")).alias("relation_hints"), max_hops(F.col("text")).alias("max_hops"))


def parse_responses(questions: DataFrame, responses: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Q6: responses(question_id, response) over the rules; what cannot be read, or names nothing, leaves the rules."""
    rules = parse_rules(questions, names)
    o = object_in(cleaned(F.col("response")))
    r = responses.select("question_id", o.alias("o"))
    named = F.upper(strip(F.coalesce(text_at(F.col("o"), "$.intent"), F.lit(""))))
    r = r.select("question_id", F.when(named.isin(INTENTS), named).otherwise("EXPLAIN").alias("i"), texts_at(F.col("o"), "$.entities").alias("e"), texts_at(F.col("o"), "$.relation_hints").alias("h"), F.try_variant_get("o", "$.constraints.max_hops", "int").alias("m"), F.col("o").isNotNull().alias("ok"))
    use = F.coalesce(F.col("ok") & (F.size("e") + F.size("h") > 0), F.lit(False)) & (strip("text") != "")
    pick = lambda a, b: F.when(use, F.col(a)).otherwise(F.col(b)).alias(b)
    return rules.join(r, "question_id", "left").select("question_id", "text", pick("i", "intent"), pick("e", "entities"), pick("h", "relation_hints"), pick("m", "max_hops"))


def rule_plans(parsed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q7: (plans, steps). Entities that are schema labels are type filters, the others start; without a start the first type is one."""
    # outer explodes here and below: inner ones would be planned behind filters that parse the texts again
    e = parsed.select("question_id", "relation_hints", F.posexplode_outer("entities").alias("pos", "entity")).where("pos is not null").join(labels.select(F.col("label").alias("entity"), F.lit(True).alias("t")).distinct(), "entity", "left")
    g = e.groupBy("question_id").agg(F.sort_array(F.collect_list(F.when(F.col("t").isNull(), F.struct("pos", "entity")))).alias("s"), F.sort_array(F.collect_list(F.when(F.col("t"), F.struct("pos", "entity")))).alias("t"))
    g = g.select("question_id", F.transform("s", lambda x: x["entity"]).alias("s"), F.transform("t", lambda x: x["entity"]).alias("t"))
    only = (F.size("s") == 0) & (F.size("t") > 0)
    g = g.select("question_id", F.when(only, F.slice("t", 1, 1)).otherwise(F.col("s")).alias("start_entities"), F.when(only, F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).otherwise(F.col("t")).alias("types"))
    none = F.array().cast("array<string>")
    full = parsed.select("question_id", "relation_hints").join(g, "question_id", "left").select("question_id", "relation_hints", F.coalesce("start_entities", none).alias("start_entities"), F.coalesce("types", none).alias("types"))
    steps = full.select("question_id", "relation_hints", F.posexplode(F.when(F.size("types") > 0, F.col("types")).otherwise(F.array(F.lit(None).cast("string")))).alias("step", "target_type"))
    hint = F.when(F.col("target_type").isNotNull(), F.get("relation_hints", F.lit(0)))
    return full.select("question_id", "start_entities"), steps.select("question_id", "step", F.lit("find_neighbors").alias("action"), "target_type", hint.alias("relation_hint"), F.lit("both").alias("direction"))


def response_plans(parsed: DataFrame, responses: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q8: plans of responses(question_id, response); without start entities the rule plan holds, without entities the plan is empty."""
    o = object_in(cleaned(F.col("response")))
    r = responses.select("question_id", o.alias("o")).select("question_id", texts_at(F.col("o"), "$.start_entities").alias("start_entities"), array_at(F.col("o"), "$.steps").alias("steps"))
    r = r.join(parsed.where(F.size("entities") > 0).select("question_id"), "question_id", "left_semi").where(F.size("start_entities") > 0)
    v = F.col("v")
    one_of = lambda path, xs: F.when(text_at(v, path).isin(xs), text_at(v, path)).otherwise(xs[0])
    hint = F.when(kind(F.try_variant_get(v, "$.relation_hint", "variant")).startswith("ARRAY"), F.try_variant_get(v, "$.relation_hint[0]", "string")).otherwise(text_at(v, "$.relation_hint"))
    steps = r.select("question_id", F.posexplode_outer("steps").alias("step", "v")).where("step is not null").select("question_id", "step", one_of("$.action", ["find_neighbors", "find_by_path"]).alias("action"), text_at(v, "$.target_type").alias("target_type"), hint.alias("relation_hint"), one_of("$.direction", ["both", "out", "in"]).alias("direction"))
    rest = parsed.where(F.size("entities") > 0).join(r.select("question_id"), "question_id", "left_anti")
    plans, rule_steps = rule_plans(rest, labels)
    return r.select("question_id", "start_entities").unionByName(plans), steps.unionByName(rule_steps)


def validated(requests: DataFrame, least: int = 1, most: int = 5, default: int = 3) -> DataFrame:
    """Q9: requests(question_id, text, max_hops) with max_hops filled and `reason`, null if valid."""
    hops = F.coalesce("max_hops", F.lit(default))
    reason = F.when(strip(F.coalesce("text", F.lit(""))) == "", "blank question").when(~hops.between(least, most), "max_hops out of range")
    return requests.select("question_id", "text", hops.alias("max_hops"), reason.alias("reason"))
