"""The same operators on streams of documents."""
