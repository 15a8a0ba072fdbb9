"""Readers and writers: text files in many encodings, HTML, EPUB, DOCX, JSON cases, Markdown sections, collections."""
