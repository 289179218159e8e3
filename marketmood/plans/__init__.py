"""Models behind one interface and the end-to-end workflows."""
