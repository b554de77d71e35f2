"""Operations on text corpora for training-data pipelines; nothing outside this folder imports it."""
