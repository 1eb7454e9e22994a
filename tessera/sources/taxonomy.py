"""What a document is about: topics of a manifest, its context, and the one group that it is assigned to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import terms, text

# fixed values: terms that tell contexts and formats, and how documents on product work are divided
ACADEMIC_TERMS = ["stanford", "university", "lecture", "assignment", "course", "syllabus", "research paper", "arxiv", "doi.org", "公开课", "课程", "讲义", "论文", "学术研究", "学习合同", "本节主线", "自测题", "视频结合学习版"]
PROJECT_TERMS = ["project plan", "prototype", "milestone", "deliverable", "acceptance criteria", "roadmap", "supplier", "产品", "项目", "原型", "里程碑", "交付", "验收", "供应商"]
PRODUCT_TERMS = ["product manager", "product management", "产品经理", "产品管理"]
PROMPT_TERMS = ["this prompt", "prompt template", "system prompt", "you are an ai assistant", "ask one question at a time", "instructions:", "input:", "output:", "提示词", "系统提示", "提示模板", "角色设定", "输出格式"]
SKILL_TERMS = ["when to use", "workflow", "skill", "framework", "methodology", "checklist", "step-by-step", "output contract", "工作流", "技能", "方法论", "框架", "检查清单"]
PRODUCT_DOMAINS = [
    ("strategy-discovery", "PM Strategy & Discovery", ["product strategy", "product discovery", "market research", "product vision", "opportunity", "customer interview", "persona", "assumption", "产品策略", "产品发现", "市场研究", "用户访谈", "机会树"], ["pm-product-strategy", "pm-product-discovery", "pm-market-research"]),
    ("execution-growth", "PM Execution & Growth", ["execution", "delivery", "shipping", "launch", "sprint", "release", "go-to-market", "marketing", "growth", "roadmap", "执行", "交付", "发布", "增长", "营销", "路线图"], ["pm-execution", "pm-ai-shipping", "pm-go-to-market", "pm-marketing-growth"]),
    ("data-tools", "PM Data & Tools", ["analytics", "metrics", "sql", "experiment", "cohort", "dashboard", "toolkit", "legal", "privacy policy", "数据分析", "指标", "实验", "工具包", "法务"], ["pm-data-analytics", "pm-toolkit", "pm-community-additions"]),
]
TAG_BONUS, HINT_BONUS = 12.0, 3.0
CHOSEN = 2.0**53 - 1  # the score of a topic that the document names
GENERIC = r"readme|index|homepage|dashboard|overview|contents|目录|索引|导航|首页|总览|概览"

_POINT = "struct<key:string,label:string,theme:string,score:double,evidence:array<string>>"
_TOPICS = "array<struct<key:string,label:string,theme:string,tag:string>>"


def term(c: Column) -> Column:
    """A name as it is compared: no extension, leading number or separators, in lower case."""
    plain = F.regexp_replace(F.regexp_replace(c, r"(?i)\.md$", ""), r"^\d{1,3}(?:[._-]|\s)+", "")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(plain, r"[_-]+", " "), r"\s+", " ")))


def profile(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, context, product, kind, domain, points, secondary, context_topics) of documents (id, path, title, tags,
    content and, if set, headings, aliases, primary, theme, others).

    ``points`` are the topics that score 1 or more (12 more for a tag ``knowledge-point-<key>``), best first, with up
    to eight of their terms that the document's text, title, tags, headings or aliases hold. ``primary`` puts a topic
    first and ``theme`` gives that one's theme; ``others`` replace the rest. A topic with ``context_only`` set is told
    by key in ``context_topics``, best first, and never leads. The topic table is a manifest's: it is collected and all
    its terms are compiled into one matcher, which reads each text once.

    Null texts, titles and tags count as empty; a document without content is judged by title and path.
    """
    has = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    empty = F.array().cast("array<string>")
    body = text.nfkc(F.coalesce(F.col("content"), F.lit("")))
    named = text.nfkc(F.concat_ws("\n", "title", "path"))
    listed = [F.array_join(F.coalesce(has(c, "array<string>"), empty), "\n") for c in ("tags", "headings", "aliases")]
    rows = docs.select(
        "id", "title", F.lower(text.nfkc(F.col("path"))).alias("path"), F.coalesce("tags", empty).alias("tags"),
        F.lower(F.when(F.trim(body) != "", body).otherwise(named)).alias("s"), F.lower(text.nfkc(F.concat_ws("\n", "title", "content", *listed))).alias("whole"),
        has("primary", "string").alias("primary"), has("theme", "string").alias("theme"), has("others", "array<string>").alias("others"),
    )
    cols = ["topic", "label", "theme", "terms"]
    side = F.col("context_only") if "context_only" in topics.columns else F.lit(False)
    table = topics.select(*cols, F.coalesce(side, F.lit(False)).alias("context_only")).collect()  # a manifest's topics
    table = sorted(table, key=lambda t: t["context_only"])
    lead = sum(not t["context_only"] for t in table)
    fixed = [PRODUCT_TERMS, PROMPT_TERMS, SKILL_TERMS, ACADEMIC_TERMS, PROJECT_TERMS, *(d[2] for d in PRODUCT_DOMAINS)]
    rows = rows.withColumn("_w", terms.weighed(F.col("s"), F.col("whole"), [t["terms"] or [] for t in table] + fixed, lead))
    tags, s, path = F.transform("tags", lambda t: term(t)), F.col("s"), F.col("path")
    known = [F.struct(F.lit(t["topic"]).alias("key"), F.lit(t["label"]).alias("label"), F.lit(t["theme"]).alias("theme"), term(F.lit(f"knowledge point {t['topic']}")).alias("tag")) for t in table]
    table_of = F.array(*known).cast(_TOPICS) if known else F.array().cast(_TOPICS)

    def point(t: Column, at: Column) -> Column:
        score = F.get("_w.scores", at) + F.when(F.array_contains(tags, t["tag"]), TAG_BONUS).otherwise(0.0)
        return F.struct(t["key"].alias("key"), t["label"].alias("label"), t["theme"].alias("theme"), score.alias("score"), F.coalesce(F.get("_w.evidence", at), empty).alias("evidence")).cast(_POINT)

    def best(first: int, n: int) -> Column:
        """Those of ``n`` topics of the table that score, best first."""
        found = F.filter(F.transform(F.slice(table_of, first + 1, n), lambda t, i: point(t, i + first)), lambda p: p["score"] >= 1)
        return F.transform(F.array_sort(F.transform(found, lambda p: F.struct((-p["score"]).alias("s"), p["key"].alias("k"), p.alias("p")))), lambda x: x["p"])

    ranked, beside = best(0, lead), F.transform(best(lead, len(table) - lead), lambda p: p["key"])
    leading = F.slice(table_of, 1, lead)

    def chosen(value: Column, score: float) -> Column:
        """The topic that a value names, or one of its own."""
        at = F.try_element_at(F.filter(F.transform(leading, lambda k, i: F.when((term(k["key"]) == term(value)) | (term(k["label"]) == term(value)), i)), lambda i: i.isNotNull()), F.lit(1))
        match = F.get(leading, at)
        own = F.struct(
            F.coalesce(match["key"], F.replace(term(value), F.lit(" "), F.lit("-"))).alias("key"), F.coalesce(match["label"], text.humanize(value)).alias("label"),
            F.coalesce(F.col("theme"), match["theme"], F.lit("custom:theme")).alias("theme"), F.lit(score).alias("score"), F.coalesce(F.get("_w.evidence", at), empty).alias("evidence"),
        )
        return own.cast(_POINT)

    rows = rows.withColumn("_first", chosen(F.col("primary"), CHOSEN))
    themed = F.transform(F.col("points"), lambda p, i: F.when((i == 0) & F.col("theme").isNotNull(), F.struct(p["key"].alias("key"), p["label"].alias("label"), F.col("theme").alias("theme"), p["score"].alias("score"), p["evidence"].alias("evidence")).cast(_POINT)).otherwise(p))
    led = F.when(F.trim("primary") != "", F.concat(F.array(F.col("_first")), F.filter("points", lambda p: p["key"] != F.col("_first.key")))).otherwise(themed)
    rows = rows.withColumn("points", ranked).withColumn("context_topics", beside).withColumn("points", led)
    listed = F.filter(F.transform("others", lambda v: chosen(v, CHOSEN - 1)), lambda p: p["key"] != F.coalesce(F.get("points", F.lit(0))["key"], F.lit("")))
    once = F.filter(listed, lambda p, i: F.array_position(F.transform(listed, lambda q: q["key"]), p["key"]) == i + 1)
    told = F.coalesce(F.size("others"), F.lit(0)) > 0
    rows = rows.withColumn("_once", F.when(told, once))
    rows = rows.withColumn("points", F.when(told & (F.size("points") > 0), F.concat(F.slice("points", 1, 1), F.col("_once"))).otherwise(F.col("points")))
    secondary = F.when(told, F.col("_once")).otherwise(F.slice("points", F.lit(2), F.size("points")))

    product, prompt, skill, of_course, of_project, *domains = (F.get("_w.scores", F.lit(len(table) + i)) for i in range(len(fixed)))
    corpus = path.rlike(r"(?:^|/)[^/]*(?:pm[- _]?skills?|pm[- _]?prompts?|product[- _]?manager)[^/]*(?:/|$)")
    tagged = F.arrays_overlap(tags, F.array(*map(F.lit, ["product management", "pm skill", "pm prompt"])))
    academic = of_course + F.when(path.rlike(r"stanford|university|公开课|课程|/lectures?/"), 3.0).otherwise(0.0)
    project = of_project + F.when(path.rlike(r"^(?:\d+[-_ .]*)?(?:work|projects?|competition|research)(?:/|$)"), 1.0).otherwise(0.0)
    project = project + F.when(s.rlike(r"type:\s*knowledge-card"), 3.0).otherwise(0.0) + F.when(s.rlike(r"(?s)scope:.{0,120}(?:work|competition)"), 2.0).otherwise(0.0)
    rows = rows.withColumns({"_product": product, "_prompt": prompt, "_skill": skill, "_academic": academic, "_project": project, "_corpus": corpus})
    about = (F.col("_product") >= 2.1) | ((F.col("_product") >= 1.3) & (F.greatest("_prompt", "_skill") >= 1)) | F.col("_corpus") | tagged
    about = about & ~(~F.col("_corpus") & (F.col("_academic") >= 2.7))
    prompts = path.rlike(r"(?:^|/)[^/]*(?:product[- _]?manager[- _]?prompts?|pm[- _]?prompts?)[^/]*(?:/|$)") | ((F.col("_prompt") >= 2.2) & (F.col("_prompt") > F.col("_skill") * 0.72))
    scored = [F.struct((score + F.when(path.rlike("|".join(hints)), HINT_BONUS).otherwise(0.0) + F.when(F.array_contains(tags, term(F.lit(f"pm domain {key}"))), TAG_BONUS).otherwise(0.0)).alias("s"), F.lit(key).alias("k")) for (key, _, _, hints), score in zip(PRODUCT_DOMAINS, domains, strict=True)]
    top = F.try_element_at(F.array_sort(F.transform(F.array(*scored), lambda x: F.struct((-x["s"]).alias("s"), x["k"].alias("k")))), F.lit(1))
    context = F.when((F.col("_academic") >= 2.7) & (F.col("_academic") > F.col("_project") + 0.7), "academic").when(F.col("_project") >= 2.4, "project").otherwise("reference")
    return rows.select(
        "id", context.alias("context"), about.alias("product"), F.when(prompts, "prompt").otherwise("skill").alias("kind"),
        F.when(top["s"] < 0, top["k"]).otherwise("execution-growth").alias("domain"), "points", secondary.alias("secondary"), "context_topics",
    )


def assign(docs: DataFrame, profiles: DataFrame, projects: DataFrame) -> DataFrame:
    """(id, key, label, parent, size, weight, contexts, topics): the group of each document, by the first that holds.

    A product format or domain, the first topic, academic research, the folder project with a telling name, or the
    document alone. ``projects`` has id and project. ``weight`` is 0.12 for product groups, which are many and alike.
    """
    labels = {k: label for k, label, _, _ in PRODUCT_DOMAINS}
    domain = F.coalesce(*[F.when(F.col("domain") == k, label) for k, label in labels.items()])
    folder = text.humanize(F.element_at(F.split("project", "/"), -1))
    telling = F.col("project").isNotNull() & ~F.col("project").startswith("@root:") & (folder != "") & ~F.lower(folder).rlike(GENERIC)
    first, prompts = F.get("points", F.lit(0)), F.col("kind") == "prompt"
    key = (
        F.when(F.col("product"), F.when(prompts, "@topic:pm-prompts").otherwise(F.concat(F.lit("@topic:pm-skills:"), "domain")))
        .when(first.isNotNull(), F.concat(F.lit("@knowledge:"), first["key"])).when(F.col("context") == "academic", "@knowledge:academic-research")
        .when(telling, F.col("project")).otherwise(F.concat(F.lit("@root:"), F.col("id").cast("string")))
    )
    label = (
        F.when(F.col("product"), F.when(prompts, "PM Prompts").otherwise(domain)).when(first.isNotNull(), first["label"]).when(F.col("context") == "academic", "学术研究方法")
        .when(telling, folder).otherwise(F.coalesce(F.when(F.col("title") != "", text.humanize(F.col("title"))), F.lit("Unclassified")))
    )
    names = F.slice(F.array_distinct(F.transform(F.concat("points", "secondary"), lambda p: p["key"])), 1, 6)
    both = docs.select("id", "title").join(profiles, "id").join(projects.select("id", "project"), "id", "left")
    out = both.select(
        "id", key.alias("key"), label.alias("label"), F.when(~F.col("product"), first["theme"]).alias("parent"), F.when(F.col("product"), 0.12).otherwise(1.0).alias("weight"),
        F.when(F.col("product"), F.array(F.lit("product-management"))).otherwise(F.array("context")).alias("contexts"),
        F.when(F.col("product"), F.array(F.lit("product-management"), F.col("kind"), F.col("domain"))).otherwise(names).alias("topics"),
    )
    return out.join(out.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "key").select("id", "key", "label", "parent", "size", "weight", "contexts", "topics")
