"""Operations of a training-data pipeline. Nothing outside this subpackage, but the entry file and the pipeline, imports it."""
