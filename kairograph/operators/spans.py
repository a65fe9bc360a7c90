"""Span labels: rules, location, alignment with tokens, agreement and validation. Interval algebra works on merged spans,
never on arrays of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.operators.medians import exact_medians

from kairograph.operators.relations import recovered_json

#: Texts that are linguistic as a whole, in any case; a blank stands for any white space.
LINGUISTIC = (
    "however", "moreover", "furthermore", "therefore", "thus", "hence", "consequently", "nevertheless", "nonetheless", "alternatively",
    "additionally", "conversely", "similarly", "accordingly", r"in\s+contrast", r"in\s+addition", r"on\s+the\s+other\s+hand", r"taken\s+together",
    r"in\s+summary", r"in\s+conclusion", r"for\s+example", r"for\s+instance", r"such\s+as", r"these\s+results", r"this\s+study", r"our\s+findings", r"we\s+found",
    r"we\s+observed", r"we\s+demonstrated", r"it\s+is", r"it\s+was", r"there\s+is", r"there\s+are", r"there\s+was", r"has\s+been", r"have\s+been", r"were\s+found",
    r"further\s+investigation", r"further\s+research", r"the\s+present\s+study", r"the\s+current\s+study", r"as\s+shown", r"as\s+described", r"as\s+reported",
    r"not\s+significant", r"no\s+significant", "significantly", "respectively", "approximately", "overall", "previously", "recently",
    "generally", "typically", "usually", "often", "detected", "examined", "evaluated", "assessed", "analyzed", "analysed", "performed",
    "conducted", "compared", "included", "obtained", "reported", "described", "demonstrated", "determined", "confirmed", "identified",
    "investigated", "suggested", "indicated", "observed", "measured", "calculated", "considered", "presented", "discussed", "patients",
    "subjects", "participants", "controls", "samples", "methods?", "results?", "conclusions?", "discussion", "background", "introduction",
    "objectives?", "purpose", "aims?",
)
#: Patterns of which one anywhere makes a text factual.
FACTUAL = (
    r"(?i)\b\w+(?:inib|tinib|ciclib|rafenib|zumab|ximab|mumab|lizumab|tuzumab|cillin|mycin|taxel|platin|mustine|rubicin|clovir|navir|asone|olone|prednisone|methasone|olol|pril|sartan)\b",
    r"^[A-Z][A-Z0-9]{1,5}$",
    r"\d+\s*(?:mg|μg|ng|ml|μl|mM|μM|nM|kg|g/[dml]|IU|%|mmol|nmol|pmol|cm|mm|μm|kDa|Da|Hz|Gy|cGy|MBq|mCi)\b",
    r"(?i)\b(?:IC50|EC50|ED50|LD50|Ki|Kd|Ka|Km|Vmax|AUC|Cmax|Tmax|t1/2|half-life)\b",
    r"(?i)\b(?:p53|p21|p27|Rb|NF-κB|NF-kB|MAPK|ERK|JNK|PI3K|AKT|mTOR|VEGF|HER2|BCR-ABL|ALK|ROS1|BRAF|KRAS|NRAS|MET|RET|PD-L1|PD-1|CTLA-4|TNF-α|TNF-alpha|IL-\d+|TGF-β|TGF-beta|IGF-\d+|EGF|FGF|PDGF|JAK\d?|STAT\d?|Wnt|Hedgehog|Notch)\b",
    r"(?i)\b(?:carcinoma|sarcoma|lymphoma|leukemia|leukaemia|melanoma|glioma|glioblastoma|adenocarcinoma|mesothelioma|neuroblastoma|retinoblastoma|hepatocellular|cholangiocarcinoma|NSCLC|SCLC|CLL|AML|ALL|CML|DLBCL|triple[- ]negative|estrogen[- ]receptor|prostate\s+cancer|breast\s+cancer|lung\s+cancer|colorectal\s+cancer|pancreatic\s+cancer|ovarian\s+cancer|gastric\s+cancer)\b",
    r"(?i)\b(?:chromosome\s+)?\d{1,2}[pq]\d",
    r"^C\d{7}$",
    r"(?i)\b(?:mammography|sonography|ultrasonography|radiography|tomography|fluoroscopy|angiography|echocardiography|endoscopy|colonoscopy|bronchoscopy|MRI|MR|CT|PET|SPECT|fMRI|X-ray|ultrasound)\b",
    r"(?i)\b(?:biopsy|resection|ablation|excision|mastectomy|lumpectomy|lobectomy|nephrectomy|chemotherapy|radiotherapy|immunotherapy|apoptosis|necrosis|angiogenesis|metastasis|proliferation|differentiation|phosphorylation|methylation|transcription|translation|sensitivity|specificity|prevalence|incidence|survival|mortality|morbidity|prognosis|biomarker|antibody|antigen|enzyme|receptor|ligand|inhibitor|agonist|antagonist|cytokine|chemokine|interferon|interleukin|serum|plasma|tissue|tumor|tumour|lesion|nodule|polyp|cyst|fibrosis|neoplasm|adenoma|papilloma|dysplasia|hyperplasia)\b",
    r"(?i)\b(?:invasive|non-invasive|noninvasive|benign|malignant|metastatic|recurrent|primary|secondary|adjuvant|neoadjuvant|palliative|curative|histological|pathological|clinical|diagnostic|intraductal|lobular|ductal|papillary|mucinous|squamous|basal|medullary|tubular|serous|microinvasive|multicentric|multifocal|bilateral|unilateral|contralateral|ipsilateral)\s+\w+",
    r"(?i)\b(?:immunohistochemistry|IHC|FISH|PCR|RT-PCR|qPCR|ELISA|Western\s+blot|flow\s+cytometry|mass\s+spectrometry|electrophoresis|chromatography|hematoxylin|eosin|H&E|Ki-67|Ki67)\b",
    r"(?i)\b(?:breast|lung|liver|kidney|colon|pancreas|ovary|ovarian|prostate|thyroid|brain|spine|spinal|bone|lymph\s+node|axillary|mediastinal|peritoneal|pleural|hepatic|renal|pulmonary|cardiac|cerebral|gastrointestinal|genitourinary)\b",
    r"(?i)\b(?:stage\s+[I]{1,3}V?|grade\s+\d|T[0-4]N[0-3]M[01]|TNM|FIGO|Gleason|RECIST|WHO\s+grade|ECOG|Karnofsky)\b",
)


def _alternatives(body: str) -> list[str]:
    """The alternatives of a pattern, at its top level."""
    out, depth, inside, k = [""], 0, False, 0
    while k < len(body):
        piece = body[k : k + 2] if body[k] == "\\" else body[k]
        if piece == "|" and not depth and not inside:
            out.append("")
        else:
            inside = piece == "[" or (inside and piece != "]")
            depth += (piece == "(") - (piece == ")") if not inside else 0
            out[-1] += piece
        k += len(piece)
    return out


def _by_letters(alternatives: list[str]) -> str:
    """The same alternatives, without regard to case, as a tree by their first letters: a place is tried by one branch of it."""
    trees, rest = {}, []
    for a in dict.fromkeys(alternatives):
        if a[:1].isascii() and a[:1].isalnum() and a[1:2] not in ("?", "*", "+", "{"):
            trees.setdefault(a[0].lower(), []).append(a[1:])
        else:
            rest.append(a)
    return "|".join([c + (tails[0] if len(tails) == 1 else f"(?:{_by_letters(tails)})") for c, tails in trees.items()] + rest)


def _factual_tests(patterns: tuple[str, ...] = FACTUAL) -> list[str]:
    """Fewer patterns, one of which is anywhere where one of ``patterns`` is: lists of whole words are one list, and a word with an
    ending is a letter with that ending."""
    words, tests = [], []
    for p in patterns:
        first, last = r"(?i)\b(?:", r")\b"
        if p.startswith(first) and p.endswith(last):
            words += _alternatives(p[len(first) : -len(last)])
        elif p.startswith(start := r"(?i)\b\w+(?:") and p.endswith(last):
            tests.append(r"(?i)\w(?:" + _by_letters(_alternatives(p[len(start) : -len(last)])) + last)
        elif p.startswith(first) and p.endswith(last := r")\s+\w+"):
            tests.append(first + _by_letters(_alternatives(p[len(first) : -len(last)])) + r")\s+\w")
        else:
            tests.append(p)
    return ([r"(?i)\b(?:" + _by_letters(words) + r")\b"] if words else []) + tests


def rule_label(text: Column | str, max_chars: int = 80) -> Column:
    """B1: null for blank texts; deferred when long; linguistic when the whole text is a listed phrase, factual when a pattern is in it; else deferred."""
    t = F.col(text) if isinstance(text, str) else text
    whole = "(?i)^(?:" + "|".join(LINGUISTIC) + ")$"

    def outcome(own: Column) -> Column:
        factual = F.lit(False)
        for pattern in _factual_tests():
            factual = factual | own.rlike("(?U)" + pattern)
        return F.when(own == "", F.lit(None)).when(F.length(own) > max_chars, "deferred").when(own.rlike(whole), "linguistic").when(factual, "factual").otherwise("deferred")

    # bound by a function, the stripped text is made once and not again in each test of it
    own = F.regexp_replace(F.regexp_replace(t, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.transform(F.array(own), outcome)[0]


def rule_spans(texts: DataFrame, text: str = "text") -> DataFrame:
    """B1 as spans over whole texts, deferred ones included (no span: null label)."""
    label = F.when(F.col("outcome") != "deferred", F.col("outcome"))
    confidence = F.when(label == "linguistic", 0.85).when(label == "factual", 0.88)
    # exploded, the outcome is not made again in each column and filter that reads it
    judged = texts.select(*[c for c in texts.columns if c != "outcome"], F.explode(F.array(rule_label(text))).alias("outcome"))
    return judged.withColumns({"label": label, "start_char": F.lit(0), "end_char": F.length(text), "confidence": confidence})


def rule_statistics(texts: DataFrame, text: str = "text") -> DataFrame:
    """B2: number of texts by outcome; blank ones don't count."""
    return texts.groupBy(rule_label(text).alias("outcome")).agg(F.count(F.lit(1)).alias("n")).filter("outcome is not null")


def hybrid_parts(texts: DataFrame, text: str = "text") -> DataFrame:
    """B3 in one pass: rule_spans of texts that aren't blank, with their part: settled by the rules, or left to another labeler."""
    part = F.when(F.col("outcome") == "deferred", "left").otherwise("settled")
    return rule_spans(texts, text).filter("outcome is not null").withColumn("part", part)


def hybrid_split(texts: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts the rules settle, and those left to another labeler; who needs both at once reads hybrid_parts."""
    spans = rule_spans(texts, text)
    return spans.filter("label is not null"), spans.filter("outcome = 'deferred'")


def normalise_label(label: Column | str) -> Column:
    """The two labels behind their other names; unknown and missing ones are linguistic."""
    own = F.lower(F.trim(F.col(label) if isinstance(label, str) else label))
    return F.when(own.isin("factual", "retrieval"), "factual").otherwise("linguistic")


#: Confidence is read as text: responses give it as a number or as a string.
_SPAN_ITEM = "struct<span:string,label:string,confidence:string>"


def _number(value: Column) -> Column:
    """The number that a text is, spaces around it aside, else null."""
    found = F.trim(value).try_cast("double")
    return F.when(~F.isnan(found), found)


def _located(rows: DataFrame, text: str, items: Column) -> DataFrame:
    """Spans of a text from response items, in order; those that aren't found in it go."""
    own = [c for c in rows.columns if c not in ("label", "span", "span_idx", "start_char", "end_char", "confidence")]
    read = rows.withColumn("_items", items).filter("_items is not null")
    places = locate_spans(F.col(text), F.transform("_items", lambda i: F.coalesce(i["span"], F.lit(""))))
    each = read.withColumn("_starts", places).select(*own, F.posexplode(F.arrays_zip("_items", "_starts")).alias("span_idx", "_x")).filter("_x._starts is not null")
    item, start = F.col("_x._items"), F.col("_x._starts")
    span = F.coalesce(item["span"], F.lit(""))
    label, confidence = normalise_label(item["label"]), clamp(F.coalesce(_number(item["confidence"]), F.lit(0.5)))
    return each.select(*own, "span_idx", start.alias("start_char"), (start + F.length(span)).alias("end_char"), span.alias("span"), label.alias("label"), confidence.alias("confidence"))


def parse_span_responses(responses: DataFrame, text: str = "text", response: str = "response") -> DataFrame:
    """Located spans (span_idx, start_char, end_char, span, label, confidence) of each text from its response, a JSON array of
    {span, label, confidence}, fenced or within words; responses that don't parse give none. Labels are normalised
    (unknown ones are linguistic), confidence, a number or the text of one, is 0.5 where missing and lies in 0 to 1."""
    return _located(responses, text, F.from_json(recovered_json(response), f"array<{_SPAN_ITEM}>")).drop(response)


def parse_batch_responses(responses: DataFrame, texts: DataFrame, batch: str = "batch_id", index: str = "text_idx", text: str = "text", response: str = "response") -> DataFrame:
    """B4, batch form: as parse_span_responses for the ``texts`` (batch, index, text) of a response {"results": {"0": [...], ...}}.

    Results of an index beyond the batch's texts go; a bare array stands for the text of a batch of one.
    """
    body = F.trim(F.col(response))
    fenced = F.regexp_extract(body, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)
    between = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    parsed = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*\{"), c)
    whole = F.coalesce(parsed(fenced), parsed(body), parsed(between))
    results = F.from_json(whole, f"struct<results:map<string,array<{_SPAN_ITEM}>>>")["results"]
    keyed = responses.select(batch, F.explode(results).alias("_key", "_found")).select(batch, F.expr("try_cast(_key as int)").alias(index), "_found")
    single = texts.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"), F.min(index).alias(index)).filter("_n = 1").drop("_n")
    bare = responses.filter(F.col(response).rlike(r"(?s)^\s*(```(json)?\s*)?\["))
    bare = bare.join(single, batch).select(batch, index, F.from_json(recovered_json(response), f"array<{_SPAN_ITEM}>").alias("_found"))
    return _located(texts.join(keyed.unionByName(bare), [batch, index]), text, F.col("_found")).drop("_found")


def clamp(value: Column | str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value) if isinstance(value, str) else value))


def locate_spans(text: Column | str, pieces: Column | str) -> Column:
    """Starts (from 0, null when not found) of the pieces of a text: from the end of the piece before, else without case
    from there, else from the text's start. A fold, since each search starts where the last one ended."""
    t = F.col(text) if isinstance(text, str) else text
    def search(piece: Column, whole: Column, at: Column) -> Column:
        rest = F.substring(whole, at + 1, F.length(whole))
        place = F.instr(rest, piece)
        return F.when(place > 0, place - 1 + at)

    def step(acc: Column, piece: Column) -> Column:
        at = acc["end"]
        start = F.coalesce(search(piece, t, at), search(F.lower(piece), F.lower(t), at), search(piece, t, F.lit(0)))
        end = F.when(start.isNull(), at).otherwise(start + F.length(piece))
        return F.struct(end.cast("int").alias("end"), F.concat(acc["starts"], F.array(start.cast("int"))).alias("starts"))

    first = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    return F.aggregate(F.col(pieces) if isinstance(pieces, str) else pieces, first, step, lambda a: a["starts"])


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Islands: overlapping or touching spans of a key as one (start_char, end_char); empty ones go."""
    order = Window.partitionBy(*keys).orderBy("start_char", "end_char")
    reach = F.max("end_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.filter("end_char > start_char").withColumn("_new", (F.col("start_char") > F.coalesce(reach, F.lit(-1))).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_island").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("_island")


#: Characters of a cell of a text: spans that meet are found among the pieces of one cell.
CELL = 256


def _pieces(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Spans cut at the cells' bounds, as (keys, _cell, start_char, end_char): as many rows as their length has cells, one at least."""
    cell = lambda at: F.floor(at / F.lit(CELL))
    cut = rows.filter("end_char > start_char").withColumn("_cell", F.explode(F.sequence(cell(F.col("start_char")), cell(F.col("end_char") - 1))))
    return cut.select(*keys, "_cell", F.greatest("start_char", F.col("_cell") * CELL).alias("start_char"), F.least("end_char", (F.col("_cell") + 1) * CELL).alias("end_char"))


def shared_characters(rows: DataFrame, islands: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """(keys, shared): characters of each of ``rows`` (keys, start_char, end_char) in the disjoint ``islands`` (key, start_char, end_char).

    Pieces meet by text and cell: a long text is many small groups, and a piece meets a cell's islands only.
    """
    other = _pieces(islands, [key]).select(key, "_cell", F.col("start_char").alias("_s"), F.col("end_char").alias("_e"))
    hits = _pieces(rows, keys).join(other, [key, "_cell"]).filter("_s < end_char and start_char < _e")
    return hits.groupBy(*keys).agg(F.sum(F.least("_e", "end_char") - F.greatest("_s", "start_char")).alias("shared"))


def token_labels(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, label): 1 where factual characters are more than half of the token's width; empty tokens 0.

    Spans are merged first, so overlaps count once.
    """
    islands = merge_spans(spans.filter("label = 'factual'").select(key, "start_char", "end_char"), [key])
    covered = shared_characters(tokens.select(key, "token", "start_char", "end_char"), islands, key, [key, "token"])
    joined = tokens.join(covered, [key, "token"], "left")
    more = F.coalesce(2 * F.col("shared") > F.col("end_char") - F.col("start_char"), F.lit(False)) & (F.col("end_char") > F.col("start_char"))
    return joined.select(key, "token", more.cast("int").alias("label"))


def mention_spans(mentions: DataFrame, labels: DataFrame) -> DataFrame:
    """Mentions with the label of their text, without case: the last label of a text wins."""
    last = labels.groupBy(F.lower("text").alias("norm")).agg(F.max_by("label", "span_idx").alias("label"))
    return mentions.withColumn("norm", F.lower("text")).join(last, "norm").drop("norm")


def label_statistics(spans: DataFrame) -> DataFrame:
    """Number, mean confidence and lengths, by label and over all (label null), with grouping sets; exact medians by selection."""
    length = (F.col("end_char") - F.col("start_char")).cast("long")
    found = spans.rollup("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.avg(length).alias("mean_length"), F.grouping("label").alias("whole")
    )
    lengths = spans.select(F.explode(F.array(F.struct(F.lit(0).alias("whole"), "label"), F.struct(F.lit(1).alias("whole"), F.lit(None).cast("string").alias("label")))).alias("group"), length.alias("length"))
    medians = exact_medians(lengths, "group", "length").select("group.*", F.col("median").alias("median_length"))
    medians = medians.select("median_length", F.col("whole").alias("_whole"), F.col("label").alias("_label"))
    found = found.join(medians, (F.col("whole") == F.col("_whole")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_label", "_whole", "whole")
    whole = spans.agg(F.count(F.lit(1)).alias("_all"))
    return found.crossJoin(F.broadcast(whole)).withColumn("ratio", F.round(F.col("n") / F.col("_all"), 4)).drop("_all")


def low_confidence(spans: DataFrame, threshold: float = 0.7) -> DataFrame:
    """B10"""
    return spans.filter(F.col("confidence") < threshold).orderBy("confidence")


def kappa(texts: DataFrame, first: DataFrame, second: DataFrame, key: str = "doc_id", length: str = "n") -> DataFrame:
    """Per document, characters that both, one or no annotator call factual, observed and expected agreement, and kappa.

    The first annotator alone is a false positive. Where chance agreement is complete, kappa is 1 if all agree, else 0.
    """
    total = texts.select(key, F.col(length).alias("_n"))
    clip = lambda s: merge_spans(s.filter("label = 'factual'").join(total, key).select(key, F.greatest("start_char", F.lit(0)).alias("start_char"), F.least("end_char", "_n").alias("end_char")), [key])
    a, b = clip(first), clip(second)
    size = lambda d, name: d.groupBy(key).agg(F.sum(F.col("end_char") - F.col("start_char")).alias(name))
    both = shared_characters(a, b, key, [key]).withColumnRenamed("shared", "tp")
    rows = total.join(both, key, "left").join(size(a, "_a"), key, "left").join(size(b, "_b"), key, "left").fillna(0, ["tp", "_a", "_b"])
    rows = rows.withColumns({"fp": F.col("_a") - F.col("tp"), "fn": F.col("_b") - F.col("tp")})
    rows = rows.withColumn("tn", F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")).filter("_n > 0")
    n = F.col("_n").cast("double")
    observed = (F.col("tp") + F.col("tn")) / n
    expected = (F.col("_a") / n) * (F.col("_b") / n) + (1 - F.col("_a") / n) * (1 - F.col("_b") / n)
    score = F.when(F.abs(1 - expected) < 1e-12, F.when(F.abs(1 - observed) < 1e-12, 1.0).otherwise(0.0)).otherwise((observed - expected) / (1 - expected))
    return rows.select(key, "tp", "fp", "fn", "tn", observed.alias("observed"), expected.alias("expected"), score.alias("kappa"))


def validate(texts: DataFrame, spans: DataFrame, key: str = "doc_id", length: str = "n", low: float = 0.15, high: float = 0.85, least: int = 1, most: int = 200, by_span: bool = False) -> DataFrame:
    """(key, n_spans, ratio, issues, valid): bounds on the spans' number and on the factual share of characters (of spans if ``by_span``)."""
    chars = F.sum(F.when(F.col("label") == "factual", F.col("end_char") - F.col("start_char")).otherwise(0))
    found = spans.groupBy(key).agg(F.count(F.lit(1)).alias("n_spans"), chars.alias("_chars"), F.count_if(F.col("label") == "factual").alias("_factual"))
    rows = texts.select(key, F.col(length).alias("_n")).join(found, key, "left").fillna(0, ["n_spans", "_chars", "_factual"])
    ratio = F.try_divide(F.col("_factual"), F.col("n_spans")) if by_span else F.try_divide(F.col("_chars"), F.col("_n"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("n_spans") == 0, "no labels"),
            F.when((F.col("n_spans") > 0) & (F.col("n_spans") < least), "too few spans"),
            F.when(F.col("n_spans") > most, "too many spans"),
            F.when((F.col("n_spans") > 0) & (F.col("ratio") < low), "ratio too low"),
            F.when((F.col("n_spans") > 0) & (F.col("ratio") > high), "ratio too high"),
        )
    )
    return rows.withColumn("ratio", ratio).select(key, "n_spans", "ratio", issues.alias("issues")).withColumn("valid", F.size("issues") == 0)


def revalidation_changes(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Valid and invalid before and after, and how many changed."""
    both = before.select(key, F.col("valid").alias("_old")).join(after.select(key, "valid"), key)
    return both.agg(
        F.count_if("_old").alias("valid_before"), F.count_if(~F.col("_old")).alias("invalid_before"), F.count_if("valid").alias("valid_after"),
        F.count_if(~F.col("valid")).alias("invalid_after"), F.count_if(F.col("_old") != F.col("valid")).alias("flipped"),
    )


def corpus_summary(validated: DataFrame, by: str) -> DataFrame:
    """Valid and invalid chunks and mean ratio per file."""
    return validated.groupBy(by).agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.avg("ratio").alias("mean_ratio"))


def review_tasks(texts: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """One review task per text as JSON, its spans in order."""
    value = F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"), F.col("span_text").alias("text"), F.array("label").alias("labels"))
    result = F.struct(F.concat(F.lit("span_"), F.col("span_idx")).alias("id"), F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("labels").alias("type"), value.alias("value"), F.col("confidence").alias("score"))
    grouped = spans.withColumnRenamed("text", "span_text").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("span_idx", result.alias("r")))).alias("rs"))
    joined = texts.select(key, "text").join(grouped, key)
    data = F.struct("text", F.col(key).cast("string").alias("source_id"))
    task = F.struct(data.alias("data"), F.array(F.struct(F.transform("rs", lambda x: x["r"]).alias("result"))).alias("annotations"))
    return joined.select(key, F.to_json(task).alias("value"))
