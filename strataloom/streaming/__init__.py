"""Stateful and time-based operators, each as a batch fold and, where it makes sense, over a stream."""
