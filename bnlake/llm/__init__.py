"""Training-data operators: tokens, language, quality, HTML, URLs, chat, duplicates, licences."""
