"""The cue table and the fixed word lists that several jobs share."""

from __future__ import annotations

CUES = (
    "title_id string, track_id string, pos long, start double, end double, text string, en string, zh string, "
    "source_language string, words array<struct<start:double,end:double,word:string>>, display boolean, "
    "display_start double, display_end double, processing_mode string"
)

# File kinds, codecs and language tags.
VIDEO_EXTENSIONS = ("mkv", "mp4", "avi", "m2ts", "ts", "mov", "wmv")
SUBTITLE_EXTENSIONS = ("srt", "ass", "ssa", "vtt")
TEXT_CODECS = ("ass", "ssa", "subrip", "srt", "webvtt", "mov_text", "text")
UNKNOWN_LANGUAGES = ("", "auto", "source", "cached source", "subtitle", "embedded subtitle")
ZH_TOKENS = ("zh", "zho", "chi", "chs", "cht", "cmn", "cn", "sc", "tc", "zh-cn", "zh-hans", "zh-tw", "zh-hant", "chinese", "简", "简体", "繁", "繁体", "中文")
EN_TOKENS = ("en", "eng", "english", "英文")
SOUND_CUES = (
    "MUSIC", "PLAYING", "LAUGH", "LAUGHS", "LAUGHING", "SIGHS", "GROANS", "SCREAM", "SCREAMING",
    "CHEERING", "APPLAUSE", "BEEP", "BEEPING", "RINGING", "WHIRRING", "EXPLOSION", "THUNDER", "GUNSHOT",
)
LANGUAGE_NAMES = (
    ("en", ("en", "eng", "english"), "english"),
    ("ja", ("ja", "jp", "jpn", "japanese"), "japanese"),
    ("ko", ("ko", "kor", "korean"), "korean"),
    ("zh", ("zh", "zho", "chi", "chs", "cht", "cmn", "cn", "chinese"), "chinese"),
    ("fr", ("fr", "fra", "fre", "french"), "french"),
    ("de", ("de", "deu", "ger", "german"), "german"),
    ("es", ("es", "spa", "spanish"), "spanish"),
)
