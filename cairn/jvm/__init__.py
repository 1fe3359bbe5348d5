"""JVM bytecode: decoding, control flow and decompilation."""
