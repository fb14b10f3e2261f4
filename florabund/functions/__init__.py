"""Column functions on the text formats of annotations, headers and ids."""
