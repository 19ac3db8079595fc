"""Schemas of the engine's tables. Times are integer milliseconds inside the engine."""

MEDIA = "media_id long, path string, content binary"
WORDS = "media_id long, turn long, pos int, word string, start_ms long, end_ms long"
SEGMENTS = "media_id long, speaker string, from_ms long, to_ms long"
MEDIA_INFO = "file_name string, duration double, duration_after_vad double, sample_rate int, max_dbfs double, rms int, language string"
HTML_ITEMS = "book_id long, item_no int, name string, kind string, html string"
CHAPTERS = "book_id string, pos int, heading string, content array<string>"
SENTENCES = "book_id string, pos int, sent_no int, sentence string"
ENTITIES = "book_id string, pos int, sent_no int, label string, ent string, `from` int, `to` int"
