"""Catalog operators: file and job libraries, policies, quotas, reconciliation and maintenance plans.

Every clock is a parameter. Plans name what should be done; nothing is deleted here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, TERMINAL = ("queued", "running"), ("completed", "failed", "cancelled")
STATUSES = ("queued", "running", "completed", "failed", "cancelled")
#: Operations by queue class, and time limits in seconds.
CLASSES = {
    "interactive": ("organize", "split", "rotate", "watermark", "page-numbers", "stamp"),
    "pdf": ("merge", "compress", "images-to-pdf"),
    "heavy": ("ocr", "pdfa", "office-to-pdf", "pdf-to-images"),
}
TIME_LIMITS = {"interactive": 600, "pdf": 1800, "heavy": 3600}
#: Limits of a service without a policy of its own.
DEFAULT_POLICY = {"rate_limit_per_minute": 120, "daily_job_limit": 1000, "max_storage_mb": 2048}
MAX_ARTIFACTS = 201
ZIP = "application/zip"
BUNDLING = ("pdf-to-images", "split-to-zip", "extract-pages-zip", "extract-images")
#: What may be put in, by operation; all others take PDF alone.
INPUT_TYPES = {
    "images-to-pdf": ["image/bmp", "image/jpeg", "image/png", "image/tiff", "image/webp"],
    "office-to-pdf": [
        "application/msword",
        "application/rtf",
        "application/vnd.ms-excel",
        "application/vnd.ms-powerpoint",
        "application/vnd.oasis.opendocument.presentation",
        "application/vnd.oasis.opendocument.spreadsheet",
        "application/vnd.oasis.opendocument.text",
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ],
}
#: Rules of parameters by operation. Numbers: least, most, whole; choices; lengths.
_MARGIN, _DPI, _PAGE = (0, 240, False), (72, 600, True), (1, 100_000, True)
NUMBERS = {
    "images-to-pdf": {"margin": _MARGIN, "dpi": _DPI},
    "pdf-to-images": {"dpi": _DPI, "first_page": _PAGE, "last_page": _PAGE},
    "watermark": {"font_size": (8, 160, False), "opacity": (0.02, 1, False), "rotation": (-180, 180, False), "margin": _MARGIN},
    "page-numbers": {"start_number": (0, 1_000_000, True), "font_size": (6, 36, False), "margin": _MARGIN},
    "stamp": {"scale": (0.03, 0.8, False), "margin": _MARGIN},
}
POSITIONS = ["center", "top-left", "top-center", "top-right", "bottom-left", "bottom-center", "bottom-right"]
CHOICES = {
    "images-to-pdf": {"page_size": ["auto", "a4", "letter"], "fit": ["contain", "cover"]},
    "pdf-to-images": {"format": ["png", "jpeg"]},
    "rotate": {"degrees": ["-90", "90", "180", "270"]},
    "ocr": {"deskew": ["true", "false"], "rotate_pages": ["true", "false"]},
    "watermark": {"position": POSITIONS},
    "page-numbers": {"position": POSITIONS},
    "stamp": {"position": POSITIONS},
}
LENGTHS = {"watermark": {"text": (1, 240)}, "page-numbers": {"format": (1, 120)}}
REQUIRED = {"split": ["pages"], "watermark": ["text"]}
UNARCHIVED = ("unlock", "protect", "grayscale", "header-footer")
UNREPEATABLE = ("unlock", "protect")


def at(now) -> Column:
    return F.lit(now).cast("timestamp")


# filters


def active_files(files: DataFrame, now) -> DataFrame:
    """FLT1: not expired; a file that expires right now is."""
    return files.where(F.col("expires_at").isNull() | (F.col("expires_at") > at(now)))


def visible_to(df: DataFrame, principal: str, owner_col: str = "source_system", wildcard: bool = False, institutional: bool = False) -> DataFrame:
    """FLT2: the principal's own rows, or all for a holder of * outside institutional mode."""
    return df if wildcard and not institutional else df.where(F.col(owner_col) == principal)


def name_contains(files: DataFrame, q: str | None) -> DataFrame:
    """FLT3: literal, case-insensitive part of the name."""
    q = (q or "").strip()
    return files.where(F.lower("original_name").contains(F.lower(F.lit(q)))) if q else files


def kind() -> Column:
    return F.when(F.col("content_type") == "application/pdf", "pdf").when(F.col("content_type").startswith("image/"), "image").otherwise("other")


def with_kind(files: DataFrame) -> DataFrame:
    """FLT4: pdf, image or other."""
    return files.withColumn("kind", kind())


def job_view(jobs: DataFrame, mine: str | None = None, status: str | None = None) -> DataFrame:
    """FLT5: jobs with their JSON columns decoded; broken JSON gives an empty list or map."""
    if mine is not None:
        jobs = jobs.where(F.col("requested_by") == mine)
    if status is not None:
        jobs = jobs.where(F.col("status") == status)
    ids = F.coalesce(F.from_json("input_file_ids_json", "array<string>"), F.array().cast("array<string>"))
    params = F.coalesce(F.from_json("params_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return jobs.select("id", "operation", "status", "progress", ids.alias("input_file_ids"), "output_file_id", params.alias("params"), "error", "requested_by", "created_at")


def job_triage(jobs: DataFrame, status: str | None = None, operation: str | None = None) -> DataFrame:
    """FLT6: eight columns without ids of files or owners."""
    for c, v in (("status", status), ("operation", operation)):
        if v is not None:
            jobs = jobs.where(F.col(c) == v)
    return jobs.select("id", "operation", "status", "progress", "created_at", "started_at", "finished_at", F.col("error").isNotNull().alias("failure_recorded"))


def deliveries(df: DataFrame, status: str | None = None, service: str | None = None, limit: int = 100) -> DataFrame:
    """FLT7: newest first."""
    for c, v in (("status", status), ("service_name", service)):
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def default_routes(spark) -> DataFrame:
    rows = [(o, c, TIME_LIMITS[c], ".zip" if o == "pdf-to-images" else ".pdf", ZIP if o == "pdf-to-images" else "application/pdf") for c, ops in CLASSES.items() for o in ops]
    return spark.createDataFrame(rows, "operation string, queue_class string, time_limit_s int, suffix string, media_type string")


def route_operations(jobs: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """FLT8: queue class, time limit and output kind; an unknown operation is refused, never defaulted."""
    # the caller's routes are broadcast only if Spark finds them small enough
    routes = F.broadcast(default_routes(jobs.sparkSession)) if routes is None else routes
    out = jobs.join(routes, "operation", "left")
    return out.withColumn("reject_reason", F.when(F.col("queue_class").isNull(), "unsupported"))


def validate_params(jobs: DataFrame) -> DataFrame:
    """FLT9: violations of the rules of an operation's parameters, sorted; parameters that aren't given are fine unless required."""
    given = F.from_json("params_json", "map<string,string>")
    broken = F.get_json_object("params_json", "$").isNull()
    op = F.col("operation")

    def rules(table: dict, wrong, message: str) -> list[Column]:
        found = [(o, name, rule) for o, names in table.items() for name, rule in names.items()]
        return [F.when((op == o) & F.coalesce(wrong(F.try_element_at(given, F.lit(name)), rule), F.lit(False)), f"{name}: {message}") for o, name, rule in found]

    def bad_number(x: Column, rule: tuple) -> Column:
        n = x.try_cast("double")
        fine = n.between(rule[0], rule[1]) & (F.lit(not rule[2]) | (n == F.floor(n)))
        return x.isNotNull() & ~F.coalesce(fine, F.lit(False))

    # a page expression: numbers from 1 or z, alone or as ranges, comma-separated
    item = r"(?:[1-9][0-9]*|z)"
    pages = F.try_element_at(given, F.lit("pages"))
    pages_ok = pages.rlike(rf"^{item}(?:-{item})?(?:,{item}(?:-{item})?)*$") & F.length(pages).between(1, 256)
    found = [
        F.when(broken, "params: not JSON"),
        F.when(op.isin("split", "rotate") & ~pages_ok, "pages: malformed"),
        F.when((op == "ocr") & ~F.try_element_at(given, F.lit("languages")).rlike("^[a-z0-9+_-]+$"), "languages: not allowed"),
        *[F.when((op == o) & ~broken & F.try_element_at(given, F.lit(name)).isNull(), f"{name}: required") for o, names in REQUIRED.items() for name in names],
        *rules(NUMBERS, bad_number, "out of range"),
        *rules(CHOICES, lambda x, allowed: ~x.isin(allowed), "not allowed"),
        *rules(LENGTHS, lambda x, size: ~F.length(x).between(*size), "not allowed"),
    ]
    return jobs.withColumn("violations", F.array_sort(F.array_compact(F.array(*found))))


# joins


def logical_name(backend: str) -> Column:
    return F.regexp_replace("stored_name", "^s3:", "") if backend == "s3" else F.col("stored_name")


def reconcile(files: DataFrame, objects: DataFrame, backend: str = "local") -> DataFrame:
    """JOIN1: records against listed objects; one row per issue.

    Copies are aggregated before the one full join on the name.
    """
    remote = F.col("stored_name").startswith("s3:")
    wrong = remote if backend == "local" else ~remote
    name = F.regexp_extract(logical_name(backend), "([^/]*)$", 1) if backend == "local" else logical_name(backend)
    records = files.select(F.col("id").alias("file_id"), F.col("stored_name").alias("recorded"), "size", wrong.alias("wrong"), name.alias("base"), logical_name(backend).alias("name"))
    misplaced = records.where("wrong").select(F.lit("backend_mismatch").alias("category"), F.col("recorded").alias("stored_name"), "file_id", F.lit(None).cast("string").alias("location"))
    right = records.where("NOT wrong")
    invalid = right.where((F.col("base") != F.col("name")) if backend == "local" else F.lit(False)).select(F.lit("invalid_stored_name"), "recorded", "file_id", F.lit(None).cast("string"))
    listed = objects.groupBy(F.col("stored_name").alias("listed")).agg(F.count("*").alias("copies"), F.collect_list(F.struct("location", F.col("size").alias("object_size"))).alias("found"))
    both = right.join(listed, F.col("name") == F.col("listed"), "full_outer")
    several = F.lit(backend == "local") & (F.col("copies") > 1)
    issue = (
        F.when(F.col("listed").isNull(), "missing_object")
        .when(F.col("file_id").isNull(), "orphan_object")
        .when(several, "duplicate_storage_name")
        .when(F.col("found")[0]["object_size"] != F.col("size"), "size_mismatch")
    )
    judged = both.withColumn("category", issue).where("category IS NOT NULL")
    orphan = F.col("category") == "orphan_object"
    places = F.when(orphan, F.transform("found", lambda f: f["location"])).otherwise(F.array(F.lit(None).cast("string")))
    matched = judged.select("category", F.coalesce("recorded", "listed").alias("stored_name"), "file_id", F.explode(places).alias("location"))
    return misplaced.union(invalid).union(matched)


def input_ids(jobs: DataFrame, *keep: str) -> DataFrame:
    """One row per job and input; broken or non-list JSON has no inputs."""
    ids = F.from_json("input_file_ids_json", "array<string>")
    return jobs.select(*keep, F.posexplode(ids).alias("pos", "file_id"))


def active_inputs(jobs: DataFrame) -> DataFrame:
    return input_ids(jobs.where(F.col("status").isin(*ACTIVE))).select("file_id").distinct()


def purge_candidates(files: DataFrame, jobs: DataFrame, now) -> DataFrame:
    """JOIN2: expired files that no queued or running job needs."""
    return files.where(F.col("expires_at") <= at(now)).join(active_inputs(jobs), F.col("id") == F.col("file_id"), "left_anti")


def in_use(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """JOIN3: files that queued or running jobs need."""
    return files.join(active_inputs(jobs), F.col("id") == F.col("file_id"), "left_semi")


#: Names that jobs give to their outputs.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
OUTPUT_NAME = rf"(?i)^({UUID})(?:\.(?:pdf|zip)|-page-[0-9]{{4}}\.(?:png|jpg))$"


def orphan_outputs(objects: DataFrame, files: DataFrame, jobs: DataFrame, now, min_age_hours: int = 24) -> DataFrame:
    """JOIN4: outputs of failed or cancelled jobs that no file refers to; names and ages are filtered before any join."""
    age = (F.unix_timestamp(at(now)) - F.unix_timestamp("modified_at")) / 3600
    named = objects.where((F.col("area") == "processed") & F.col("modified_at").isNotNull() & (age >= max(min_age_hours, 24)))
    named = named.withColumn("job_id", F.lower(F.regexp_extract("stored_name", OUTPUT_NAME, 1))).where("job_id <> ''").withColumn("age_hours", F.floor(age).cast("long"))
    free = named.join(files.select("stored_name"), "stored_name", "left_anti")
    dead = jobs.where(F.col("status").isin("failed", "cancelled")).select(F.lower("id").alias("job_id"), F.col("status").alias("job_status"))
    return free.join(dead, "job_id").select("job_id", "stored_name", "location", "size", "age_hours", "job_status")


def check_inputs(jobs: DataFrame, files: DataFrame, now) -> DataFrame:
    """JOIN5: the first failing rule of each job: 404 missing, 410 expired, 403 foreign, 415 wrong type; NULL if none."""
    rows = input_ids(jobs, "id", "operation", "requested_by").join(files.select(F.col("id").alias("fid"), "source_system", "content_type", "expires_at"), F.col("file_id") == F.col("fid"), "left")
    wanted = reduce(lambda c, kv: c.when(F.col("operation") == kv[0], F.col("content_type").isin(kv[1])), INPUT_TYPES.items(), F).otherwise(F.col("content_type") == "application/pdf")
    rank = F.when(F.col("fid").isNull(), 1).when(F.col("expires_at") <= at(now), 2).when(F.col("source_system") != F.col("requested_by"), 3).when(~wanted, 4)
    worst = rows.groupBy("id").agg(F.min(rank).alias("rank"))
    code = F.when(F.col("rank") == 1, 404).when(F.col("rank") == 2, 410).when(F.col("rank") == 3, 403).when(F.col("rank") == 4, 415)
    return jobs.select("id", "operation").join(worst, "id", "left").select("id", "operation", code.alias("failed_rule"))


def _output_rows(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each job with its links; a completed job without links has its primary file alone, as bundle for operations that make
    ZIP files, else as result."""
    done = jobs.select(F.col("id").alias("job_id"), "operation", "status", F.col("output_file_id").alias("primary_id"), "requested_by")
    linked = artifacts.select("job_id", F.col("file_id").alias("linked_id"), F.col("role").alias("linked_role"), "ordinal", F.lit(True).alias("linked"))
    rows = done.join(linked, "job_id", "left")
    legacy = F.col("linked").isNull() & (F.col("status") == "completed") & F.col("primary_id").isNotNull()
    alone = F.when(F.col("operation").isin(*BUNDLING), "bundle").otherwise("result")
    return rows.withColumns({"file_id": F.when(legacy, F.col("primary_id")).otherwise(F.col("linked_id")), "role": F.when(legacy, alone).otherwise(F.col("linked_role")), "there": legacy | F.col("linked").isNotNull()})


def _manifest_code(held: DataFrame) -> DataFrame:
    """job_id, manifest and artifacts from _output_rows() with the files' owner and content_type."""
    root = F.col("role").isin("result", "bundle")
    facts = held.groupBy("job_id", "status", "primary_id").agg(
        F.count_if("there").alias("n"),
        F.count_if(F.col("there") & (F.col("owner").isNull() | (F.col("owner") != F.col("requested_by")))).alias("foreign"),
        F.count_if(F.col("file_id") == F.col("primary_id")).alias("primaries"),
        F.count_if(root).alias("roots"),
        F.count_if(root & (F.col("file_id") == F.col("primary_id"))).alias("primary_roots"),
        F.count_if(F.col("role") == "result").alias("results"),
        F.count_if((F.col("role") == "bundle") & (F.col("content_type") != ZIP)).alias("unzipped"),
        F.count_if(F.col("there") & ~F.coalesce(F.col("role").isin("result", "bundle", "part"), F.lit(False))).alias("strange"),
        F.count_if((F.col("role") != "part") & F.col("ordinal").isNotNull()).alias("misnumbered"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "part", F.coalesce("ordinal", F.lit(0))))).alias("ordinals"),
    )
    parts = F.size("ordinals")
    numbered = (parts == 0) | (F.col("ordinals") == F.sequence(F.lit(1), F.greatest(parts, F.lit(1))))
    bad_roles = (F.col("roots") != 1) | (F.col("primary_roots") != 1) | ~numbered | ((F.col("results") > 0) & (F.col("n") > 1)) | (F.col("unzipped") > 0) | (F.col("strange") > 0) | (F.col("misnumbered") > 0)
    code = (
        F.when(F.col("status") != "completed", "409")
        .when(F.col("primary_id").isNull(), "410")
        .when(F.col("n") > MAX_ARTIFACTS, "409")
        .when((F.col("foreign") > 0) | (F.col("primaries") == 0), "410")
        .when(bad_roles, "409")
        .otherwise("ok")
    )
    return facts.select("job_id", code.alias("manifest"), F.col("n").alias("artifacts"))


def artifact_manifest(jobs: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN6: per job, how many artifacts it has and whether they are complete and consistent (ok, 409 or 410)."""
    held = _output_rows(jobs, artifacts).join(files.select(F.col("id").alias("file_id"), F.col("source_system").alias("owner"), "content_type"), "file_id", "left")
    return _manifest_code(held)


def _sound_rows(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The rows of _output_rows() of jobs that break none of the rules of _manifest_code() that need no file, with their position."""
    per = Window.partitionBy("job_id")
    root, part, primary = F.col("role").isin("result", "bundle"), F.coalesce(F.col("role") == "part", F.lit(False)), F.col("file_id") == F.col("primary_id")
    number = F.coalesce("ordinal", F.lit(0))
    rows = _output_rows(jobs, artifacts).where("there").withColumn("rank", F.row_number().over(per.orderBy(part.desc(), number)))
    counts = {
        "n": F.lit(True),
        "primaries": primary,
        "roots": root,
        "primary_roots": root & primary,
        "results": F.col("role") == "result",
        "strange": ~F.coalesce(F.col("role").isin("result", "bundle", "part"), F.lit(False)),
        "misnumbered": ((F.col("role") != "part") & F.col("ordinal").isNotNull()) | (part & (F.col("rank") != number)),
    }
    rows = rows.withColumns({f"_{k}": F.count_if(c).over(per) for k, c in counts.items()})
    rows = rows.withColumn("position", F.row_number().over(per.orderBy((~primary).cast("int"), number, "file_id")))
    rows = rows.where((F.coalesce("status", F.lit("completed")) == "completed") & F.col("primary_id").isNotNull() & (F.col("_n") <= MAX_ARTIFACTS))
    rows = rows.where("_primaries > 0 AND _roots = 1 AND _primary_roots = 1 AND (_results = 0 OR _n = 1) AND _strange = 0 AND _misnumbered = 0")
    return rows.select("job_id", "requested_by", "position", "file_id", "role", "ordinal")


def manifest_rows(jobs: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN6: the artifacts of each consistent manifest, the primary one first, then by ordinal; position counts from 1.

    A job has 201 artifacts at most. What needs no file is settled where jobs and links meet. Then owners and types of files
    name the jobs that break a rule, and only the rest meet whole file rows, which are shuffled once and stay where they are.
    """
    rows = _sound_rows(jobs, artifacts)
    owners = files.select(F.col("id").alias("file_id"), F.col("source_system").alias("owner"), "content_type")
    met = rows.select("job_id", "requested_by", "file_id", "role").join(owners, "file_id", "left")
    breaks = F.col("owner").isNull() | (F.col("owner") != F.col("requested_by")) | ((F.col("role") == "bundle") & (F.col("content_type") != ZIP))
    good = rows.drop("requested_by").join(met.where(breaks).select("job_id").distinct(), "job_id", "left_anti")
    facts = files.select(F.col("id").alias("file_id"), F.col("original_name").alias("file_name"), "content_type", "size", "sha256", "source_system", "expires_at")
    return good.join(facts, "file_id").select("job_id", "position", "file_id", "role", "ordinal", "file_name", "content_type", "size", "sha256", "source_system", "expires_at")


def effective_policy(services: DataFrame, policies: DataFrame, defaults: dict | None = None) -> DataFrame:
    """JOIN7: the service's own policy (a stored 0 stays: unlimited), else the defaults and no webhook."""
    own = policies.withColumn("own", F.lit(True))
    out = services.select("service_name").distinct().join(own, "service_name", "left")
    limits = {k: F.when(F.col("own"), F.col(k)).otherwise(v).cast("int").alias(k) for k, v in (defaults or DEFAULT_POLICY).items()}
    return out.select("service_name", *limits.values(), F.when(F.col("own"), F.col("webhook_url")).alias("webhook_url"))


def enqueue_webhooks(jobs: DataFrame, policies: DataFrame, known: DataFrame, now) -> DataFrame:
    """JOIN8: a delivery per finished job of a service with a webhook, once per (job, event)."""
    hooks = policies.where("webhook_url IS NOT NULL").select(F.col("service_name").alias("requested_by"), F.col("webhook_url").alias("url"))
    new = jobs.where(F.col("status").isin(*TERMINAL)).join(hooks, "requested_by").select(F.col("id").alias("job_id"), F.col("requested_by").alias("service_name"), "url", F.concat(F.lit("job."), "status").alias("event"))
    new = new.join(known.select("job_id", "event"), ["job_id", "event"], "left_anti")
    return new.withColumn("status", F.lit("queued")).withColumn("attempt_count", F.lit(0)).withColumn("next_attempt_at", at(now))


def dead_missing_jobs(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """JOIN9: unfinished deliveries whose job is gone."""
    open_ = df.where(F.col("status").isin("queued", "retrying"))
    return open_.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_anti").withColumn("status", F.lit("dead")).withColumn("last_error", F.lit("job no longer exists"))


def host_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """JOIN10: whether a rule (a host, or *. and a domain) allows each host; the rules are a small operator-made table.

    Suffixes of the host are matched by equality, so that this is a hash join and not a comparison of all pairs.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    known = rules.select(clean(F.col("rule")).alias("rule")).where("rule <> '*' AND rule <> ''").distinct()
    host = clean(F.col("host"))
    labels = F.split(host, r"\.")
    above = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    tries = urls.select("host").distinct().select("host", F.explode(F.concat(F.array(host), above)).alias("rule"))
    hit = tries.join(known, "rule", "left_semi").select("host").distinct().withColumn("allowed", F.lit(True))
    return urls.join(hit, "host", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def owner_archives(archives: DataFrame, files: DataFrame, owner: str, limit: int = 100) -> DataFrame:
    """JOIN11: of the newest archives, those of the owner's files. The limit comes first."""
    newest = archives.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    own = files.where(F.col("source_system") == owner).select(F.col("id").alias("file_id"))
    return newest.join(own, "file_id", "left_semi")


def archive_upserts(jobs: DataFrame, files: DataFrame, archives: DataFrame, integration: str = "archive") -> DataFrame:
    """JOIN12: records as they are after finished PDF outputs are submitted; an old error is cleared."""
    outputs = jobs.where((F.col("status") == "completed") & ~F.col("operation").isin(*UNARCHIVED)).select(F.col("output_file_id").alias("file_id"))
    outputs = outputs.join(files.where("content_type = 'application/pdf'").select(F.col("id").alias("file_id")), "file_id", "left_semi").distinct()
    new = outputs.withColumn("integration_name", F.lit(integration)).withColumn("submitted", F.lit(True))
    out = archives.join(new, ["file_id", "integration_name"], "full_outer")
    sent = F.coalesce("submitted", F.lit(False))
    return out.select("file_id", "integration_name", "external_id", F.when(sent, "submitting").otherwise(F.col("status")).alias("status"), F.when(~sent, F.col("error")).alias("error"), F.col("id").isNull().alias("inserted"))


def file_delete_plan(ids: DataFrame, files: DataFrame, artifacts: DataFrame, jobs: DataFrame, archives: DataFrame) -> DataFrame:
    """JOIN13: what goes with the chosen files; a file in use is blocked and nothing of it is touched.

    Whatever belongs to a file is one list, which meets the choice and the files in use once.
    """
    none = F.lit(0).cast("long")
    everything = [
        files.select(F.lit("delete_file").alias("action"), F.col("id").alias("file_id"), F.col("id").alias("target"), F.col("size").alias("bytes")),
        artifacts.select(F.lit("drop_artifact"), "file_id", "job_id", none),
        jobs.select(F.lit("clear_output"), "output_file_id", "id", none),
        archives.select(F.lit("drop_archive"), "file_id", "id", none),
    ]
    used = active_inputs(jobs).withColumn("used", F.lit(True))
    rows = reduce(DataFrame.union, everything).join(ids.select("file_id").distinct(), "file_id", "left_semi").join(used, "file_id", "left")
    free, own = F.col("used").isNull(), F.col("action") == "delete_file"
    return rows.where(free | own).select(F.when(free, F.col("action")).otherwise("blocked").alias("action"), "file_id", F.when(free, F.col("target")).alias("target"), F.when(free, F.col("bytes")).otherwise(none).alias("bytes"))


def history_clear_plan(jobs: DataFrame, known: DataFrame, artifacts: DataFrame, owner: str) -> DataFrame:
    """JOIN14: an owner's finished jobs with their deliveries and artifacts."""
    mine = jobs.where((F.col("requested_by") == owner) & F.col("status").isin(*TERMINAL)).select(F.col("id").alias("job_id"))
    rows = [
        known.join(mine, "job_id", "left_semi").select(F.lit("drop_delivery").alias("action"), "job_id", F.col("id").alias("target")),
        artifacts.join(mine, "job_id", "left_semi").select(F.lit("drop_artifact"), "job_id", "file_id"),
        mine.select(F.lit("drop_job"), "job_id", "job_id"),
    ]
    return reduce(DataFrame.union, rows)


def retryable(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """JOIN15: failed or cancelled jobs that may run again and whose inputs all still exist."""
    ended = jobs.where(F.col("status").isin("failed", "cancelled") & ~F.col("operation").isin(*UNREPEATABLE))
    rows = input_ids(ended, "id").join(files.select(F.col("id").alias("fid")), F.col("file_id") == F.col("fid"), "left")
    lacking = rows.where("fid IS NULL").select("id").distinct()
    return ended.join(lacking, "id", "left_anti")


def stalled_leases(jobs: DataFrame, queue_status: DataFrame, journal: DataFrame, now, grace: int = 300) -> DataFrame:
    """JOIN16: running jobs whose lease ran out, whose queue entry has ended, and that committed nothing."""
    late = F.unix_timestamp(at(now)) - F.unix_timestamp("lease_expires_at") >= max(grace, 60)
    held = jobs.where((F.col("status") == "running") & F.col("lease_token").isNotNull() & F.col("output_file_id").isNull() & late)
    ended = queue_status.where(F.col("status").isin("failed", "stopped", "canceled")).select("rq_job_id", F.col("status").alias("queue_status"))
    committed = journal.where("state = 'committed'").select(F.col("job_id").alias("id"), "lease_epoch")
    return held.join(ended, "rq_job_id").join(committed, ["id", "lease_epoch"], "left_anti").select("id", "rq_job_id", "lease_epoch", "lease_token", "queue_status")


def settle_journal(journal: DataFrame, committed: DataFrame, cleanup: DataFrame) -> DataFrame:
    """JOIN17: a job's planned writes become committed, compensated or needs_review.

    committed: job_id, lease_token, stored_name of the writes that have a file; cleanup: the same and succeeded. No
    result counts as failure, as does one failure among several results for a name.
    """
    key = ["job_id", "lease_token", "stored_name"]
    kept = committed.select(*key).distinct().withColumn("kept", F.lit(True))
    results = cleanup.groupBy(*key).agg(F.bool_and(F.coalesce("succeeded", F.lit(False))).alias("succeeded"))
    rows = journal.where("state = 'planned'").join(kept, key, "left").join(results, key, "left")
    state = F.when(F.col("kept"), "committed").when(F.coalesce("succeeded", F.lit(False)), "compensated").otherwise("needs_review")
    return rows.select("id", "job_id", "stored_name", state.alias("state"))


# aggregates


def job_status_counts(jobs: DataFrame) -> DataFrame:
    """AGG1: all five statuses, zeros included."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def library_totals(files: DataFrame) -> DataFrame:
    """AGG2."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def storage_usage(files: DataFrame, policies: DataFrame, now, incoming: int = 0) -> DataFrame:
    """AGG3: active bytes per service and whether `incoming` more would pass its limit; 0 means unlimited."""
    used = active_files(files, now).groupBy(F.col("source_system").alias("service_name")).agg(F.sum("size").alias("bytes"))
    limit = F.col("max_storage_mb").cast("long") * 1024 * 1024
    out = used.join(effective_policy(used, policies), "service_name")
    return out.select("service_name", "bytes", "max_storage_mb", ((limit > 0) & (F.col("bytes") + incoming > limit)).alias("over"))


def daily_job_usage(jobs: DataFrame, policies: DataFrame, now) -> DataFrame:
    """AGG4: jobs per service since midnight UTC."""
    today = jobs.where(F.col("created_at") >= F.date_trunc("day", at(now))).groupBy(F.col("requested_by").alias("service_name")).agg(F.count("*").alias("n"))
    out = today.join(effective_policy(today, policies), "service_name")
    return out.select("service_name", "n", "daily_job_limit", ((F.col("daily_job_limit") > 0) & (F.col("n") >= F.col("daily_job_limit"))).alias("exhausted"))


def reconcile_summary(issues: DataFrame, files: DataFrame, objects: DataFrame, detail_limit: int = 200) -> DataFrame:
    """AGG5: counts by category over all issues, with the totals of both sides."""
    tagged = issues.select(F.col("category").alias("item")).union(files.select(F.lit("records"))).union(objects.select(F.lit("objects")))
    counts = tagged.groupBy().pivot("item", ["backend_mismatch", "duplicate_storage_name", "invalid_stored_name", "missing_object", "orphan_object", "size_mismatch", "records", "objects"]).count()
    counts = counts.na.fill(0)
    total = sum((F.col(c) for c in counts.columns[:6]), F.lit(0))
    return counts.withColumn("healthy", total == 0).withColumn("truncated", total > detail_limit)


def cleanup_report(files: DataFrame, plan: DataFrame, now) -> DataFrame:
    """AGG11: expired files seen, and what the plan frees."""
    seen = files.where(F.col("expires_at") <= at(now)).select(F.lit(0).alias("planned"), F.lit(0).cast("long").alias("size"))
    rows = seen.union(plan.select(F.lit(1), "size"))
    return rows.agg(F.count_if(F.col("planned") == 0).alias("scanned"), F.count_if(F.col("planned") == 1).alias("purged"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


# windows, sorts and pages


def admit_daily(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """WIN11: the first requests of each service and day, up to its limit; the others are refused."""
    day = F.to_date("created_at")
    services = requests.select(F.col("requested_by").alias("service_name"))
    ranked = requests.withColumn("rank", F.row_number().over(Window.partitionBy("requested_by", day).orderBy("created_at", "id")))
    limits = effective_policy(services, policies).select(F.col("service_name").alias("requested_by"), "daily_job_limit")
    return ranked.join(limits, "requested_by").withColumn("admitted", (F.col("daily_job_limit") <= 0) | (F.col("rank") <= F.col("daily_job_limit")))


SORTS = {"created_at": F.col, "name": lambda _: F.lower("original_name"), "size": F.col, "expires_at": F.col}


def library(files: DataFrame, now, q: str | None = None, file_kind: str | None = None, owner: str | None = None, include_expired: bool = False) -> DataFrame:
    """The files that a library page is cut from."""
    out = files if include_expired else active_files(files, now)
    out = name_contains(out if owner is None else visible_to(out, owner), q)
    return out if file_kind is None else out.where(kind() == file_kind)


def library_page(files: DataFrame, now, sort: str = "created_at", order: str = "desc", limit: int = 50, offset: int = 0, after: tuple | None = None, **filters) -> DataFrame:
    """TOP1: one page; the id breaks ties in the same direction. NULL expiry is last ascending, first descending.

    after: the (sort value, id) of the last row seen, as a cheaper way than a deep offset.
    """
    rows, key = library(files, now, **filters), SORTS[sort](sort)
    if after is not None:
        last, same = F.col("id") > after[1] if order == "asc" else F.col("id") < after[1], key.eqNullSafe(F.lit(after[0]))
        # nulls come last ascending and first descending
        if after[0] is None:
            further = F.lit(False) if order == "asc" else key.isNotNull()
        else:
            further = (key > F.lit(after[0])) | key.isNull() if order == "asc" else key < F.lit(after[0])
        rows = rows.where(further | (same & last))
    by = [key.asc_nulls_last(), F.col("id").asc()] if order == "asc" else [key.desc_nulls_first(), F.col("id").desc()]
    return rows.orderBy(*by).offset(offset).limit(limit)


def library_count(files: DataFrame, now, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
    """TOP1: total of a page's library and whether more follows."""
    return library(files, now, **filters).agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > offset + limit)


def job_page(jobs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """TOP2: newest first; one row more than asked for tells that there are more."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit + 1)


def due_deliveries(df: DataFrame, now, batch: int = 50) -> DataFrame:
    """TOP3: of the earliest open deliveries, those that are due. The limit comes first."""
    open_ = df.where(F.col("status").isin("queued", "retrying"))
    return open_.orderBy("next_attempt_at", "created_at", "id").limit(batch).where(F.col("next_attempt_at") <= at(now))


def issue_page(issues: DataFrame, limit: int = 200) -> DataFrame:
    """TOP4."""
    return issues.orderBy("category", "stored_name", F.coalesce("file_id", F.lit("")), F.coalesce("location", F.lit(""))).limit(limit)


def scope_audit(keys: DataFrame, roles: dict[str, list[str]], allowed: list[str]) -> DataFrame:
    """SET7: scopes of keys with roles expanded; an admin holds *; what isn't allowed is invalid."""
    own = F.coalesce(F.from_json("scopes_json", "array<string>"), F.array().cast("array<string>"))
    table = F.create_map(*[x for r, s in roles.items() for x in (F.lit(r), F.array(*map(F.lit, s)))]) if roles else F.create_map().cast("map<string,array<string>>")
    of_role = F.coalesce(F.try_element_at(table, F.col("role")), F.array().cast("array<string>"))
    every = F.array_union(F.array_union(own, of_role), F.when(F.col("role") == "admin", F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")))
    known = F.array(*map(F.lit, [*allowed, "*"]))
    return keys.select("id", F.array_sort(F.array_distinct(every)).alias("scopes"), F.array_sort(F.array_except(every, known)).alias("invalid"))
