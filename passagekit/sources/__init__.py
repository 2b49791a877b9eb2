"""Readers of the corpus, its translations, morphology, indexes and stores."""
