"""papyrion: document-structure analytics on Spark."""
