"""DataFrame operators: extraction, chunking, retrieval, answering and evaluation."""
