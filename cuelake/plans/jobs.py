"""End-to-end jobs: choice of a source per title, the model passes, and the track-pair job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as X
from cuelake.operators import batch, display, frames, language, pair, report, resume, split, tracks
from cuelake.sources import files as listings
from cuelake.sources import sinks
from cuelake.streaming import replies as replies_of

# Sources of a title's cues, best first.
SOURCES = ("cache", "existing_sidecar", "existing_embedded", "sidecar", "embedded", "audio")

Model = Callable[[list[str]], list[str]]


def choose_source(available: DataFrame, mode: str = "auto") -> DataFrame:
    """(title_id, source): the best of the sources in ``available`` (title_id, source); a mode other than
    auto leaves only the source of that name."""
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    rows = available.where(rank > 0)
    rows = rows if mode == "auto" else rows.where(F.col("source") == mode)
    return rows.groupBy("title_id").agg(F.min_by("source", rank).alias("source"))


#: Cues of a source, or a function from the titles that better sources have (title_id) to the cues of others.
Source = DataFrame | Callable[[DataFrame], DataFrame]


def resolve_cues(sources: dict[str, Source], mode: str = "auto", store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Cues of each title from its best source that has any. sources: name to cues of equal columns.

    Sources are read one after another, best first, and each only for the titles that no better one has: the
    titles found are taken out by an anti-join below whatever a source computes row by row, and a source that
    is a function gets them to leave their files out before any is read. With ``store`` each source's cues are
    written once and what follows looks at what is stored; without it Spark may read a source again.
    """
    found, taken = None, None
    for name in sorted((n for n in sources if n in SOURCES and mode in ("auto", n)), key=SOURCES.index):
        source, rows = sources[name], None
        if callable(source):
            rows = source(_no_titles() if taken is None else taken)
        else:
            rows = source
        rows = rows if taken is None else rows.join(taken, "title_id", "left_anti")
        rows = rows.withColumn("source", F.lit(name))
        rows = rows if store is None else store(rows, f"cues-{name}")
        mine = rows.select("title_id").distinct()
        taken = mine if taken is None else taken.unionByName(mine)
        taken = taken if store is None else store(taken, f"titles-{name}")
        found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
    if found is None:
        raise ValueError(f"no source for mode {mode}")
    return found


def _no_titles() -> DataFrame:
    return SparkSession.active().createDataFrame([], "title_id string")


def sidecar_source(files: DataFrame, read: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """A source over a listing (title_id, path): ``read`` gets the files of the titles that are left, as
    (title_id, path), and gives their cues."""
    return lambda taken: read(files.join(taken, "title_id", "left_anti"))


def _complete(cues: DataFrame) -> DataFrame:
    """cues with en, zh and source_language, null where the source has none."""
    return cues.withColumns({c: F.lit(None).cast("string") for c in ("en", "zh", "source_language") if c not in cues.columns})


def prepare(cues: DataFrame) -> DataFrame:
    """Split for display and cap short texts."""
    return split.sane_timing(split.split_cues(cues))


def _texts(cues: DataFrame, proofread: bool, mapping: dict[str, str]) -> DataFrame:
    """cues with item (variant or null) to new_en and new_zh, and valid."""
    if proofread:
        own_en, own_zh = X.original_pair(F.col("text"), F.col("en"), F.col("zh"))
        new_en = X.clean_english_track(F.coalesce(batch.field("corrected_english", "en"), own_en))
        new_zh = X.simplify(X.clean_subtitle_text(F.coalesce(batch.field("corrected_chinese", "chinese", "zh"), own_zh)), mapping)
        base = own_en
    else:
        new_en = X.clean_subtitle_text(F.coalesce(batch.field("corrected_text", "corrected_source", "corrected_english"), F.col("text")))
        new_zh = X.clean_subtitle_text(F.coalesce(batch.field("chinese_translation"), F.lit("")))
        base = F.col("text")
    rows = cues.withColumn("new_en", new_en).withColumn("new_zh", new_zh)
    return rows.withColumn("valid", X.language_valid(base, F.col("new_en"), F.col("new_zh")))


def _fallback(rows: DataFrame, proofread: bool, mapping: dict[str, str]) -> DataFrame:
    """Texts of invalid replies go back to the originals; a translation that is empty is the correction."""
    if proofread:
        own_en, own_zh = X.original_pair(F.col("text"), F.col("en"), F.col("zh"))
        en, zh = X.clean_english_track(own_en), X.simplify(X.clean_subtitle_text(own_zh), mapping)
    else:
        en = zh = X.clean_subtitle_text("text")
    rows = rows.withColumn("_en", F.when(F.col("valid"), F.col("new_en")).otherwise(en)).withColumn("_zh", F.when(F.col("valid"), F.col("new_zh")).otherwise(zh))
    return rows if proofread else rows.withColumn("_zh", F.coalesce(X.falsy(F.col("_zh"), F.col("_en")), F.lit("")))


def apply_replies(cues: DataFrame, replies: DataFrame, batches: DataFrame, proofread: bool = False, mapping: dict[str, str] | None = None, retry: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Processed cues: reply items by (title, batch, index), checked, applied, with display times.

    A missing item leaves the cue as it is. Without ``retry``, ``batch.bounds`` will do for batches. ``retry`` gets the cues whose reply was of the wrong language
    (title_id, batch_id, index, pos, start, end, text ..., before, after and the context's bounds) and gives
    their new items (title_id, pos, item), whose fields go over those of the first.
    """
    mapping, cues = mapping or {}, batch.assign(cues)
    items = batch.reply_items(replies)
    around = batches.select("title_id", "batch_id", "context_start", "context_end", *(() if retry is None else ("before", "after")))
    rows = cues.join(items, ["title_id", "batch_id", "index"], "left").join(around, ["title_id", "batch_id"])
    rows = _texts(rows, proofread, mapping)
    if retry is not None:
        again = retry(rows.where(~F.col("valid")).drop("item", "new_en", "new_zh", "valid")).select("title_id", "pos", F.col("item").alias("_again"))
        fields = "map_filter(cast(item as map<string, variant>), (k, v) -> not map_contains_key(cast(_again as map<string, variant>), k))"
        merged = F.expr(f"to_variant_object(map_concat({fields}, cast(_again as map<string, variant>)))")
        rows = rows.join(again, ["title_id", "pos"], "left").withColumn("item", F.coalesce(merged, "_again", "item")).drop("_again", "new_en", "new_zh", "valid")
        rows = _texts(rows, proofread, mapping)
    rows = _fallback(rows, proofread, mapping)
    rows = rows.select("*", *display.directive("item")).withColumn("flag", F.coalesce("flag", F.lit(True)))
    rows = display.apply_timing(rows.drop("display", "display_start", "display_end"))
    mode = "proofread_existing_chinese" if proofread else "translate"
    rows = rows.withColumn("en", F.col("_en")).withColumn("zh", F.col("_zh")).withColumn("processing_mode", F.lit(mode))
    rows = rows.select("title_id", "pos", "start", "end", "text", "en", "zh", "source_language", "display", "display_start", "display_end", "processing_mode")
    return display.extend_over_hidden(rows)


def single_retry(model: Model, store: Callable[[DataFrame, str], DataFrame], attempts: int = batch.SINGLE_ATTEMPTS, proofread: bool = False, language: str = "", mapping: dict[str, str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A retry for ``apply_replies``: a request for each cue alone, with the context of its batch, in rounds.

    A round asks once for every cue that has no reply of the right language yet and stores the answers;
    after ``attempts`` rounds, or when none is left, the good items are returned. Calls that fail and
    replies that are no list count as a try.
    """

    def retry(rows: DataFrame) -> DataFrame:
        left, good = store(rows, "retry-cues"), None
        for turn in range(attempts):
            if left.isEmpty():
                break
            zero = F.lit(0).cast("long")
            line = X.bilingual_prompt_line(zero, F.col("start"), F.col("end"), F.col("text"), F.col("en"), F.col("zh")) if proofread else X.prompt_line(zero, F.col("start"), F.col("end"), F.col("text"))
            asked = left.select("title_id", F.col("pos").alias("batch_id"), F.lit(1).alias("n"), line.alias("target"), "before", "after", "context_start", "context_end")
            asked = batch.requests(asked, "proofread" if proofread else "translate", language)
            replies = store(batch.run_model(asked, model, 1, 0.0, abort=False), f"retry-{turn}")
            items = batch.first_item(replies).withColumnRenamed("batch_id", "pos")
            told = _texts(left.join(items, ["title_id", "pos"]), proofread, mapping or {}).where("valid").select("title_id", "pos", "item")
            left = store(left.join(told, ["title_id", "pos"], "left_anti"), f"retry-left-{turn}")
            good = told if good is None else good.unionByName(told)
        return rows.select("title_id", "pos", F.lit(None).cast("variant").alias("item")).limit(0) if good is None else good

    return retry


def process(cues: DataFrame, model: Model, store: Callable[[DataFrame, str], DataFrame], proofread: bool = False, source_language: str = "auto", mapping: dict[str, str] | None = None, attempts: int = batch.ATTEMPTS, pause: float = batch.PAUSE, cached: DataFrame | None = None, replies_at: str | None = None) -> DataFrame:
    """The model pass over cues: requests, replies, checks, retries, display times.

    ``store(df, name)`` writes a table and reads it back; replies go through it, so that no action calls
    the model twice. ``cached`` holds cues of an earlier run: titles where they fit go on behind the last
    whole batch, and only requests of batches that are left are sent. With ``replies_at``, a folder, replies
    are stored there batch by batch as they come: if the model fails, what it has answered stays, a rerun asks
    for the rest only, and ``processed_so_far`` gives the cues that are done.
    """
    task, mode = ("proofread", "proofread_existing_chinese") if proofread else ("translate", "translate")
    cues = _complete(cues)
    batches = batch.context(cues, bilingual=proofread)
    todo, kept = cues, None
    if cached is not None:
        todo = resume.remaining(cues, cached, batch.BATCH, mode)
        kept = cached.join(resume.compatible(cached, cues, mode).where("fits").select("title_id"), "title_id", "left_semi").join(todo.select("title_id", "pos"), ["title_id", "pos"], "left_anti")
    left = batch.assign(todo).select("title_id", "batch_id").distinct()
    asked = batch.requests(batches.join(left, ["title_id", "batch_id"], "left_semi"), task, source_language)
    replies = replies_of.ask(asked, model, replies_at, attempts, pause) if replies_at else store(batch.run_model(asked, model, attempts, pause), "replies")
    done = apply_replies(todo, replies, batches, proofread, mapping, single_retry(model, store, proofread=proofread, language=source_language, mapping=mapping))
    resume.assert_timing_kept(todo, done)
    if kept is None:
        return done
    return display.extend_over_hidden(done.unionByName(kept.select(*done.columns)))


def processed_so_far(cues: DataFrame, replies_at: str, proofread: bool = False, source_language: str = "auto", mapping: dict[str, str] | None = None) -> DataFrame:
    """The processed cues of each title up to its first batch without a stored reply under ``replies_at``: what
    an earlier, unfinished ``process`` has to show, in the form that it takes as ``cached``."""
    cues = _complete(cues)
    batches = batch.context(cues, bilingual=proofread)
    asked = batch.requests(batches, "proofread" if proofread else "translate", source_language)
    asked = asked.select("title_id", "batch_id", F.md5("prompt").alias("asked"))
    replies = replies_of.stored(cues.sparkSession, replies_at)
    told = asked.join(replies, replies_of.KEY, "left")
    until = told.groupBy("title_id").agg(F.min(F.when(F.col("raw").isNull(), F.col("batch_id"))).alias("until"))
    done = batch.assign(cues).join(until, "title_id").where(F.col("until").isNull() | (F.col("batch_id") < F.col("until"))).drop("until", "batch_id", "index")
    return apply_replies(done, told.where("raw is not null"), batches, proofread, mapping)


def translate_texts(cues: DataFrame, model: Model, replies_at: str, source_language: str = "auto", attempts: int = batch.ATTEMPTS, pause: float = batch.PAUSE) -> DataFrame:
    """(title_id, pos, start, end, text, en, zh): cues corrected and translated by prompts without times.

    The variant for tracks that have their timing settled: replies hold ``corrected_english`` and
    ``chinese_translation`` only, a missing item or field leaves the text, a missing translation is the
    correction, and no cue is hidden or moved. Replies are stored batch by batch under ``replies_at``.
    """
    batches = batch.context(cues, timed=False)
    replies = replies_of.ask(batch.requests(batches, "translate", source_language, timed=False), model, replies_at, attempts, pause)
    rows = batch.assign(cues).join(batch.reply_items(replies), ["title_id", "batch_id", "index"], "left")
    en = X.clean_subtitle_text(F.coalesce(batch.field("corrected_english", "corrected_text"), F.col("text")))
    rows = rows.withColumn("en", en)
    rows = rows.withColumn("zh", X.clean_subtitle_text(F.coalesce(batch.field("chinese_translation"), F.col("en"))))
    return rows.select("title_id", "pos", "start", "end", "text", "en", "zh")


def route(cues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues to translate, cues whose Chinese is to be proofread) by title."""
    flags = language.chinese_presence(cues)
    pick = lambda yes: cues.join(flags.where("has_chinese" if yes else "not has_chinese").select("title_id"), "title_id", "left_semi")
    return pick(False), pick(True)


def subtitle_job(sources: dict[str, Source], model: Model, store: Callable[[DataFrame, str], DataFrame], mode: str = "auto", mapping: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Cues from the best source, prepared, stored, sent through the model, rendered, with both reports."""
    cues = resolve_cues(sources, mode, store)
    source = store(prepare(_complete(cues)), "source")
    fresh, existing = route(source)
    done = process(fresh, model, store, mapping=mapping).unionByName(process(existing, model, store, proofread=True, mapping=mapping))
    done = store(done, "processed")
    files = {f"ass_{layer}": sinks.render_ass(done, layer) for layer in ("en", "zh", "bilingual")}
    return {"source": source, "processed": done, "report_source": report.timing(source), "report_done": report.timing(done), **files}


def track_pair_job(probed: DataFrame, cues: DataFrame, mapping: dict[str, str] | None = None, translate: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Best English and Chinese track of each title, their cues (title_id, index, pos, ...) paired.

    cues may come from text tracks and, by ``picture_cues``, from picture tracks alike. Only Traditional and
    Cantonese tracks are simplified. Titles need an English track. ``translate`` (cues to cues with zh, as a
    model pass gives) makes the Chinese side of titles that have no Chinese track, cue by cue; without it
    they are given under ``untranslated`` alone.
    """
    en_track = tracks.best_english(probed, in_label=False).select("title_id", "index")
    zh_track = tracks.best_chinese(probed).select("title_id", "index", "zh_kind").join(en_track.select("title_id"), "title_id", "left_semi")
    en, zh = cues.join(en_track, ["title_id", "index"]).drop("index"), cues.join(zh_track, ["title_id", "index"]).drop("index")
    plain = F.col("zh_kind").isin("zh-Hant", "zh-yue")
    zh = zh.withColumn("text", F.when(plain, X.simplify("text", mapping or {})).otherwise(F.col("text"))).drop("zh_kind")
    rest = en.join(zh_track.select("title_id"), "title_id", "left_anti")
    paired = en.join(zh_track.select("title_id"), "title_id", "left_semi")
    if translate is not None:
        columns = ["title_id", "pos", "start", "end", "text"]
        made = translate(rest).select("title_id", "pos", "start", "end", F.col("zh").alias("text"))
        paired, zh = paired.select(*columns).unionByName(rest.select(*columns)), zh.select(*columns).unionByName(made)
    pairs = pair.greedy_pairs(paired, zh)
    return {"pairs": pairs, "statistics": pair.pair_statistics(pairs), "ass": sinks.render_pairs(pairs), "srt_en": sinks.render_srt(en), "untranslated": rest}


def _readable(cues: DataFrame, track: DataFrame, *more: str) -> DataFrame:
    """Cues of the chosen tracks that a reader takes, without blank ones, numbered anew."""
    rows = cues.join(track.where(tracks.codec_class().isNotNull()).select("title_id", "index", *more), ["title_id", "index"])
    rows = rows.where(X.strip(F.coalesce("text", F.lit(""))) != "")
    order = Window.partitionBy("title_id").orderBy("pos")
    return rows.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).drop("index")


def embedded_job(probed: DataFrame, cues: DataFrame, language_tag: str, overrides: DataFrame | None = None) -> DataFrame:
    """Cues of each title's preferred readable track; blank texts go, and titles left with none give none."""
    rows = _readable(cues, tracks.preferred(probed, language_tag, overrides).withColumn("_lang", F.col("lang")), "_lang")
    tag = F.coalesce(X.falsy(F.col("_lang")), F.lit(language_tag))
    return rows.select("title_id", "pos", "start", "end", "text", tag.alias("source_language"))


def existing_pair_tracks(probed: DataFrame, overrides: DataFrame | None = None, ocr_language: str = "auto") -> DataFrame:
    """(title_id, zh_index, zh_kind, en_index, ocr_language): the tracks of titles that hold Chinese already.

    The best Chinese and the best English track, each replaced by the title's override (title_id,
    track_index, zh_index, en_index; any may be null). zh_index and en_index count if there is such a
    subtitle track, whatever its label (an unlabelled Chinese one is zh). track_index takes the Chinese
    place if it is a Chinese track, else the English one if it is English; a title whose track_index names
    no subtitle track has no row, nor has one without Chinese. The English track is null if it is the
    Chinese one. The language of picture tracks follows the kind of Chinese unless it is given.
    """
    rows = probed.where(tracks.is_subtitle()).withColumn("kind_of", tracks.chinese_kind()).withColumn("english", tracks.is_english(True))
    one = F.struct("index", F.coalesce("kind_of", F.lit("zh")).alias("kind"), "kind_of", "english")
    zh = tracks.best_chinese(probed).select("title_id", F.col("index").alias("zh0"), F.col("zh_kind").alias("kind0"))
    en = tracks.best_english(probed).select("title_id", F.col("index").alias("en0"))
    best = rows.select("title_id").distinct().join(zh, "title_id", "left").join(en, "title_id", "left")
    if overrides is None:
        overrides = best.select("title_id", *[F.lit(None).cast("int").alias(c) for c in ("track_index", "zh_index", "en_index")]).limit(0)
    named = best.join(overrides.select("title_id", *[F.col(c).alias(f"_{c}") for c in ("track_index", "zh_index", "en_index")]), "title_id", "left")
    for c in ("track_index", "zh_index", "en_index"):
        named = named.join(rows.select("title_id", F.col("index").alias(f"_{c}"), one.alias(c)), ["title_id", f"_{c}"], "left")
    named = named.where(F.col("_track_index").isNull() | F.col("track_index").isNotNull())
    zh_index, kind = F.coalesce("zh_index.index", "zh0"), F.coalesce(F.when(F.col("zh_index").isNotNull(), F.col("zh_index.kind")), F.col("kind0"))
    en_index = F.coalesce("en_index.index", "en0")
    chinese = F.col("track_index.kind_of").isNotNull()
    zh_index, kind = F.when(chinese, F.col("track_index.index")).otherwise(zh_index), F.when(chinese, F.col("track_index.kind_of")).otherwise(kind)
    en_index = F.when(~chinese & F.coalesce("track_index.english", F.lit(False)), F.col("track_index.index")).otherwise(en_index)
    out = named.select("title_id", zh_index.alias("zh_index"), kind.alias("zh_kind"), en_index.alias("en_index")).where("zh_index is not null")
    out = out.withColumn("en_index", F.when(F.col("en_index") != F.col("zh_index"), F.col("en_index")))
    own = F.when(F.col("zh_kind").isin("zh-Hant", "zh-yue"), "chinese_cht").otherwise("ch")
    return out.withColumn("ocr_language", F.lit(ocr_language) if ocr_language not in ("", "auto") else own)


def existing_pair_job(probed: DataFrame, cues: DataFrame, mapping: dict[str, str] | None = None, overrides: DataFrame | None = None, ocr_language: str = "auto", store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Cues of titles that hold an embedded Chinese track, merged with their English one if there is any.

    cues (title_id, index, pos, start, end, text) are those of all tracks. Blank cues go; a title whose
    Chinese track is left with none gives none and falls to its next source. With ``store`` all tracks' cues are
    read once, and pairing looks at those of the chosen tracks; without it Spark may read all of them for each step.
    """
    chosen = existing_pair_tracks(probed, overrides, ocr_language)
    if store is not None:
        chosen = store(chosen, "pair-tracks")
        either = chosen.select("title_id", F.explode(F.array("zh_index", "en_index")).alias("index"))
        cues = store(cues.join(either, ["title_id", "index"], "left_semi"), "pair-cues")
    of = lambda c: probed.join(chosen.select("title_id", F.col(c).alias("index")), ["title_id", "index"], "left_semi")
    zh, en = (_readable(cues, of(c)).select("title_id", "pos", "start", "end", "text") for c in ("zh_index", "en_index"))
    if store is not None:
        zh, en = store(zh, "pair-zh"), store(en, "pair-en")
    return pair.merge_tracks(en, zh, "existing Chinese embedded subtitle", mapping)


def picture_job(pictures: DataFrame, texts: DataFrame, language_tag: str = "en", limit: int = 0, cached: DataFrame | None = None) -> DataFrame:
    """Cues of picture tracks: frames merged, detections read in order.

    ``cached`` holds what an earlier run gave. Tracks with as many cues there as they have merged frames keep
    them and are not read again.
    """
    merged = frames.merge_frames(pictures, limit)
    if cached is None:
        return frames.ocr_cues(merged, frames.reading_order(texts, language_tag))
    count = lambda rows, name: rows.groupBy("track_id").agg(F.count("*").alias(name))
    cached = cached.withColumnRenamed("title_id", "track_id")
    same = count(merged, "n").join(count(cached, "m"), "track_id").where("n = m").select("track_id")
    fresh = frames.ocr_cues(merged.join(same, "track_id", "left_anti"), frames.reading_order(texts, language_tag))
    return fresh.unionByName(cached.join(same, "track_id", "left_semi").withColumnRenamed("track_id", "title_id").select(*fresh.columns))


def picture_cues(cues: DataFrame, owners: DataFrame) -> DataFrame:
    """Cues of ``picture_job``, whose title_id names their track, as cues of tracks: owners (track_id, title_id,
    index) say whose they are."""
    return cues.withColumnRenamed("title_id", "track_id").join(owners, "track_id").drop("track_id")


def name_titles(listing: DataFrame, model: Model, store: Callable[[DataFrame, str], DataFrame], tag: str, cached: DataFrame | None = None, attempts: int = batch.ATTEMPTS, pause: float = batch.PAUSE) -> DataFrame:
    """(path, modificationTime, model, movie_name, series_name, name_source) of the files in ``listing``.

    The model named ``tag`` is asked for each file that ``cached``, an earlier result, does not hold under
    the same path, time and model. A file whose replies never parse is named by its file name.
    """
    key = ["path", "modificationTime", "model"]
    files = listing.select("path", "modificationTime", F.lit(tag).alias("model")).distinct()
    left = files if cached is None else files.join(cached.select(*key), key, "left_anti")
    keys = '{"series_name": "...", "movie_name": "...", "kind": "movie or series"}'
    prompt = F.concat(F.lit("Name the film or the series and its episode that this file holds, without release tags; keep episode marks.\n\n"), X.file_name(F.col("path")), F.lit(f"\n\nAnswer with one JSON object {keys} and nothing else."))
    asked = left.select(F.col("path").alias("title_id"), F.lit(0).cast("long").alias("batch_id"), prompt.alias("prompt"))
    replies = store(batch.run_model(asked, model, attempts, pause, abort=False), "names").select(F.col("title_id").alias("path"), "raw")
    named = batch.parse_names(left.join(replies, "path")).select(*key, "movie_name", "series_name", "name_source")
    kept = None if cached is None else files.join(cached.select(*named.columns), key)
    return named if kept is None else named.unionByName(kept.select(*named.columns))


def analysis(listing: DataFrame, probed: DataFrame, cues: DataFrame, cached: DataFrame) -> DataFrame:
    """One row a title: main video, number of sidecars and the best, tracks, progress, guessed source.

    The guess looks at sidecars, then embedded subtitles, then audio, whatever is stored.
    """
    video = listings.main_videos(listing)
    side = listings.rank_sidecars(video, listing, console=True)
    side = side.groupBy("title_id").agg(F.count("*").alias("sidecars"), F.min_by("path", "rank").alias("best_sidecar"))
    own = probed.groupBy("title_id").agg(F.count_if(tracks.is_subtitle()).alias("subtitle_tracks"), F.count_if(tracks.is_audio()).alias("audio_tracks"))
    rows = video.select("title_id", "path", "length").join(side, "title_id", "left").join(own, "title_id", "left").join(report.progress(cues, cached), "title_id", "left")
    zero = {c: 0 for c in ("sidecars", "subtitle_tracks", "audio_tracks", "completed", "visible")}
    rows = rows.na.fill(zero)
    guess = F.when(F.col("sidecars") > 0, "sidecar").when(F.col("subtitle_tracks") > 0, "embedded").otherwise("audio")
    return rows.withColumn("source", guess)


def status(cues: DataFrame, cached: DataFrame, log: DataFrame, running: DataFrame, chars: int = 8000) -> DataFrame:
    """Progress of each title beside the stage of the run of that name and the tail of its log."""
    runs = report.stages(log, running).join(report.log_text(log, chars), "run_id", "left").withColumnRenamed("run_id", "title_id")
    return report.progress(cues, cached).join(runs, "title_id", "left")
