"""Column functions: text, codecs, prompts, token sequences, image sizes and boxes."""
