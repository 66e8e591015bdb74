"""Pruning plans: which layers a pruned model keeps."""
