"""Everything that reads one PDF file; no Spark in here.

``reader`` resolves objects, ``filters`` and ``ciphers`` decode streams,
``fonts`` turns codes into text, ``interpreter`` runs page content into glyphs,
``layout`` turns glyphs into reading-order text, ``pictures`` decodes images and
``extract`` puts a file's rows together.  ``builder`` writes test files.
"""
